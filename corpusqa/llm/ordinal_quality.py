"""Quality classification by ordinal (cumulative-link) regression on graded ratings.

A document has one score, the sum of the weights of its hashed words and beginnings of words (present
or not) and the mean weight of its hashed byte trigrams; thresholds in ascending order cut the score into grades:
P(grade > j) = sigmoid(score - threshold_j).  Weights and thresholds are shared by all grades and
fitted together.  ``rate`` gives the expected grade and the probability of each tail.

Grades of the labels: 0 toxic, 1 of low quality, 2 good.  Defined results: null text counts as empty
and is rated by the thresholds alone; without labels every tail has probability 1/2; labels that are
null teach nothing; repeated rows give repeated rows; of several labels of one document each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, lower_table, mix, slices, text_buffer

WORD_CELLS, GRAM_CELLS = 1 << 17, 1 << 14
#: Bytes of the beginnings of words that count as words of their own.
BEGINNINGS = (4, 6, 8)
#: Bound of the labelled documents that are learned from, in the order of a hash of doc_id, and of
#: the bytes of each of them (longer ones teach nothing).
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 16
GRADES = 3


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2).cast("int")


@dataclass
class OrdinalModel:
    words: np.ndarray
    grams: np.ndarray
    thresholds: np.ndarray


def _cells(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct word cells and the cells of all its trigrams."""
    h, at, edge = hasher(data, offsets)
    stop = np.repeat(offsets[1:], np.diff(edge))
    lower = lower_table()[data].astype(np.uint64)
    words, alive, part = [h >> np.uint64(40)], np.ones(len(h), bool), np.zeros(len(h), np.uint64)
    for j in range(max(BEGINNINGS)):
        place = np.minimum(at + j, max(0, len(data) - 1))
        alive &= (at + j < stop) & ~hasher.space[data[place]] if len(data) else alive
        part = np.where(alive, mix(part * np.uint64(257) + lower[place]) if len(data) else part, part)
        if j + 1 in BEGINNINGS:
            words.append(np.where(alive, (part + np.uint64(j)) >> np.uint64(40), words[0]))
    word = (np.stack(words) % np.uint64(WORD_CELLS)).astype(np.int64)
    x = data.astype(np.uint32)
    gram = np.zeros(0, np.int32)
    if len(x) >= 3:
        g = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        g ^= g >> np.uint32(15)
        gram = ((g * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int32)
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield np.unique(word[:, edge[i] : edge[i + 1]]), gram[a : max(a, b - 2)]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 120, decay: float = 2e-4) -> OrdinalModel:
    """Learn from at most ``sample_rows`` labelled documents.  ``labels`` has doc_id and grade.

    The driver gets hashed cells of the sample, at most ``SAMPLE_BYTES`` bytes of text each.
    """
    known = labels.where("grade IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("grade"))
    rated = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("text_hash", F.xxhash64("text"))
    chosen = known.join(rated.select("doc_id", "text_hash"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "text_hash").limit(sample_rows)
    grades = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list("grade").alias("grades"))
    picked = rated.join(F.broadcast(grades), ["doc_id", "text_hash"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                words, cells, shares = [], [], []
                for w, g in _cells(*text_buffer(part.column(0)), hasher):
                    c, n = np.unique(g, return_counts=True)
                    words.append(w.astype(np.int32).tobytes())
                    cells.append(c.astype(np.int32).tobytes())
                    shares.append((n / max(1, len(g))).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(v, pa.binary()) for v in (words, cells, shares))], names=["doc_id", "text_hash", "grades", "words", "cells", "shares"])

    cells_of = picked.select("text", F.col("doc_id").cast("long"), "text_hash", "grades").mapInArrow(hashed, "doc_id long, text_hash long, grades array<int>, words binary, cells binary, shares binary")
    # Equal rows meet in one, with as many grades as were chosen of them.
    rows = cells_of.groupBy("doc_id", "text_hash").agg(*(F.first(c).alias(c) for c in ("grades", "words", "cells", "shares"))).toPandas()
    none = OrdinalModel(np.zeros(WORD_CELLS, np.float32), np.zeros(GRAM_CELLS, np.float32), np.zeros(GRADES - 1))
    if rows.empty:
        return none
    rows = rows.explode("grades").rename(columns={"grades": "grade"}).sort_values(["doc_id", "grade", "text_hash"])
    words = [np.frombuffer(b, np.int32) for b in rows["words"]]
    cells = [np.frombuffer(b, np.int32) for b in rows["cells"]]
    seen = np.bincount(np.concatenate(words), minlength=WORD_CELLS)
    useful = seen >= max(4, 2e-3 * len(rows))  # rarer words teach nothing
    words = [w[useful[w]] for w in words]
    at = np.concatenate([np.concatenate((w, c + WORD_CELLS)) for w, c in zip(words, cells)])
    gram_scale = 30.0
    value = np.concatenate([np.concatenate((np.full(len(w), 0.2, np.float32), gram_scale * np.frombuffer(s, np.float32))) for w, s in zip(words, rows["shares"])])
    doc = np.repeat(np.arange(len(rows)), [len(w) + len(c) for w, c in zip(words, cells)])
    y = rows["grade"].to_numpy(np.int64)
    above = (y[:, None] > np.arange(GRADES - 1)[None]).astype(np.float64)
    balance = np.bincount(y, minlength=GRADES)
    weight = (len(y) / np.maximum(1, balance))[y] ** 0.5
    weight /= weight.sum()
    w = np.zeros(WORD_CELLS + GRAM_CELLS)
    share = np.clip(above.mean(0), 0.02, 0.98)
    cut = np.minimum.accumulate(np.log(share / (1 - share)))
    low, gaps = -cut[0], np.log(np.maximum(np.diff(-cut), 1e-2))  # thresholds: low, low + exp(gaps) ...
    params = [w, np.array([low]), gaps]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rounds + 1):
        w, low, gaps = params
        cuts = low[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(doc, w[at] * value, minlength=len(rows))
        tail = 1 / (1 + np.exp(cuts[None] - score[:, None]))
        # likelihood of the grade is the difference of two tails
        upper = np.concatenate((np.ones((len(y), 1)), tail), 1)
        lower = np.concatenate((tail, np.zeros((len(y), 1))), 1)
        i = np.arange(len(y))
        p = np.maximum(upper[i, y] - lower[i, y], 1e-9)
        slope = upper * (1 - upper)
        drop = lower * (1 - lower)
        d_score = -weight * (slope[i, y] - drop[i, y]) / p
        d_cut = np.zeros((len(y), GRADES - 1))
        has_upper, has_lower = y > 0, y < GRADES - 1
        d_cut[i[has_upper], y[has_upper] - 1] += (weight * slope[i, y] / p)[has_upper]
        d_cut[i[has_lower], y[has_lower]] -= (weight * drop[i, y] / p)[has_lower]
        d_cut = d_cut.sum(0)
        d_gaps = np.array([d_cut[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps)
        grads = [np.bincount(at, d_score[doc] * value, minlength=len(w)) + decay * w, np.array([d_cut.sum()]), d_gaps]
        for k, (p_, g, (m, v)) in enumerate(zip(params, grads, state)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] = p_ - (0.05 if k == 0 else 0.03) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    w, low, gaps = params
    cuts = low[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return OrdinalModel((0.2 * w[:WORD_CELLS]).astype(np.float32), (gram_scale * w[WORD_CELLS:]).astype(np.float32), cuts)


def rate(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_grade, tail_1, tail_2): P(grade >= 1) and P(grade >= 2) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = OrdinalModel(**held.value), WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                score = np.array([float(m.words[w].sum(dtype=np.float64)) + (float(m.grams[g].mean(dtype=np.float64)) if len(g) else 0.0) for w, g in _cells(*text_buffer(part.column(1)), hasher)])
                tail = 1 / (1 + np.exp(m.thresholds[None] - score[:, None]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1])], names=["doc_id", "expected_grade", "tail_1", "tail_2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tail_1 double, tail_2 double")
