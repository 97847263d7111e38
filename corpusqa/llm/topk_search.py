"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights, floor(scale * x) of each component x; a component's place
is its term.  All vectors, as candidates, are dealt out to blocks by a hash of their row, and every
block gets all queries as a stream.  A block holds the postings of its candidates: for each term the
weights of its rows, as one array where many rows have the term, else as (row, weight) lists.  A
query's terms one after the other scatter their weighted postings into an array of scores, the best
are selected by partition, and the selections of all blocks are merged by a ranked window.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; an
empty vector scores 0 with all; of vectors of different length the missing components count as 0;
weights beyond 64 bits are cut to their range, sums wrap around; ties go to the smaller id, null ids
last, then to the earlier of the equal rows; each repeated row is a query and a candidate of its own;
a null id is no query; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Candidates of a block at most (about; a task holds their postings), and at least where that leaves few blocks.
BLOCK_ROWS, LEAST_ROWS = 1 << 16, 1 << 12
#: Candidates whose scores a query fills at a time.
CHUNK = 1 << 13
#: Share of a chunk's rows from which on a term's postings are one array.
FULL = 0.25


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, id, weights) of the vectors that take part; row is unique."""
    unfit = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).where(~unfit)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda x: F.floor(x * scale)).alias("weights"))


class Postings:
    """The postings of a chunk of candidates, by term; candidates are in the order in which ties go."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        n = len(rows)
        self.largest = max((abs(int(weights.min())), abs(int(weights.max()))), default=0) if len(weights) else 0
        kind = np.int32 if self.largest < 1 << 31 else np.int64
        starts = np.cumsum(lengths) - lengths
        term = np.arange(len(weights)) - np.repeat(starts, lengths)
        held = np.flatnonzero(weights)
        held = held[np.argsort(term[held], kind="stable")]
        place = np.repeat(np.arange(n), lengths)[held]
        edges = np.searchsorted(term[held], np.arange((int(lengths.max()) if n else 0) + 1))
        self.terms: list[tuple[np.ndarray | None, np.ndarray]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= FULL * n:
                whole = np.zeros(n, kind)
                whole[place[a:b]] = weights[held[a:b]]
                self.terms.append((None, whole))
            else:
                self.terms.append((place[a:b], weights[held[a:b]].astype(kind)))
        self.scores = {np.int32: np.zeros(n, np.int32), np.int64: np.zeros(n, np.int64)}
        self.spare = {np.int32: np.zeros(n, np.int32), np.int64: np.zeros(n, np.int64)}

    def accumulate(self, query: np.ndarray) -> np.ndarray:
        """Scores of all candidates, in 32 bits where no sum can leave them."""
        terms = np.flatnonzero(query[: len(self.terms)]).tolist()
        kind = np.int32 if self.largest < 1 << 31 and sum(abs(int(query[t])) for t in terms) * self.largest < 1 << 31 else np.int64
        scores, spare = self.scores[kind], self.spare[kind]
        scores[:] = 0
        for t in terms:
            places, weights = self.terms[t]
            weight = kind(query[t])
            if places is None:
                np.multiply(weights, weight, out=spare, dtype=kind)
                scores += spare
            else:
                scores[places] += weights.astype(kind, copy=False) * weight
        return scores

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in order, scores) of the k best, of equal ones the first."""
        scores = self.accumulate(query)
        places = np.arange(len(scores))
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > least)
            places = np.sort(np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)])))
        return places, scores[places].astype(np.int64)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    lists = batch.column("weights")
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return batch.column("row").to_numpy(), batch.column("id"), np.diff(lists.offsets.to_numpy()), values


def _postings(parts: list[pa.RecordBatch]) -> list[Postings]:
    """Chunks of one block's candidates in the order of (id, row), null ids last."""
    if not parts:
        return []
    table = pa.Table.from_batches(parts).select(["row", "id", "weights"])
    table = table.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
    return [Postings(*_columns(chunk)) for at in range(0, table.num_rows, CHUNK) for chunk in table.slice(at, CHUNK).combine_chunks().to_batches()]


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_row, query_id, rank, row, id, score): the k best other rows of each row of ``vectors`` (row, id, weights) that is a query."""
    spark = vectors.sparkSession
    vectors = cut(vectors)  # rows keep their numbers
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(2 * partitions(spark), n // LEAST_ROWS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    candidates = vectors.select(block.alias("block"), F.lit(False).alias("asks"), "row", "id", "weights")
    queries = vectors.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "row", "id", "weights")
    dealt = candidates.unionByName(queries).repartitionById(blocks, "block").sortWithinPartitions("asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        chunks: list[Postings] | None = None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(asks, True))
            if first:
                parts.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            if chunks is None:
                chunks, parts = _postings(parts), []
            rows, ids, lengths, weights = _columns(batch.slice(first))
            ends = np.cumsum(lengths).tolist()
            out: list[list] = [[], [], [], [], []]
            for i, (row, vec_id, end) in enumerate(zip(rows.tolist(), ids.to_pylist(), ends)) if chunks else ():
                query = weights[end - int(lengths[i]) : end]
                places, scores = zip(*(chunk.best(query, k + 1) for chunk in chunks))  # its own row may be among them
                met_rows, met_ids, met_scores = np.concatenate([c.rows[p] for c, p in zip(chunks, places)]), pa.concat_arrays([c.ids.take(pa.array(p)) for c, p in zip(chunks, places)]), np.concatenate(scores)
                first_best = np.argsort(~met_scores, kind="stable")  # chunks, and places in them, are in the order of ties
                first_best = first_best[met_rows[first_best] != row][:k]
                out[0].append(np.full(len(first_best), row))
                out[1].extend([vec_id] * len(first_best))
                out[2].append(met_rows[first_best])
                out[3].append(met_ids.take(pa.array(first_best)))
                out[4].append(met_scores[first_best])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0])), pa.array(out[1], pa.int64()), pa.array(np.concatenate(out[2])), pa.concat_arrays(out[3]), pa.array(np.concatenate(out[4]))],
                    names=["query_row", "query_id", "row", "id", "score"],
                )

    found = dealt.select("asks", "row", "id", "weights").mapInArrow(run, "query_row long, query_id long, row long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "row", "id", "score")
