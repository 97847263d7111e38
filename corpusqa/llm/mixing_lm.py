"""Language-model scoring by logistic context mixing.

A text is a row of words (A-Z lower-cased) and an end.  A word that training texts have is coded by
bits of its hash, from the root of a binary tree down to one of 2**DEPTH leaves; the leaf's words share
its rest by their counts.  At each node several predictors say how likely each branch is, each from
the branches that training words took there in its context: none, the word before (exact, a table that
grows with the corpus), and hashes of that word's ending and of its beginning and length.  A path's
log10 probability is told to within 0.002.  Their
log-odds, weighted by a gate that the predictor's evidence opens, add up to the mixed log-odds, and a
table of the depth and the mixed value refines them.  A new word is spelled, bit by bit, by predictors
over hashed contexts of its last bytes, mixed in the same way and learned from the words that training
texts have once.

All counts cover all training texts.  They live in buckets: one of the words' hashes, one of the hashes of the words
before; chunks of documents ask for what they need, so that no vocabulary and no table that grows is
broadcast.  Gates and refinement are learned online in each bucket, every branch being left out of the
counts that predict it; the buckets' weights are averaged, their hits added up, and both then rest, so
that a document's score doesn't depend on its neighbours.

Beside it a word model with add-one counts gives a base score.

Defined results: null text counts as empty, whose only token is the end; without training documents
all branches are even; repeated rows give repeated rows; rows without doc_id are scored, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, cut, forget, lower_table, mix, text_buffer

#: Depth of the tree of words; bits of a hashed class of the word before, and depth to which it predicts.
DEPTH, CLASS_BITS, CLASS_DEPTH = 16, 8, 9
#: Orders of the spelling predictors and bits of their cells.
ORDERS, SPELL_BITS = (1, 2, 3), 18
GATES, STEPS = 8, 33
#: Steps in which a path's log10 probability is sent.
FINE = 256
#: Added to either count of a branch.
PRIOR = 0.02
RATE, RUN = 0.02, 1 << 14
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
#: Hashes of the end and of what stands before the first word.
END, START = 0x5851F42D4C957F2D, 0x14057B7EF767814F
SPACE = 32


_SMALL = np.arange(1 << 16)
_LOGS = np.log(_SMALL + PRIOR).astype(np.float32)
_LEVELS = np.minimum(GATES - 1, np.log2(_SMALL + 1).astype(np.int8) // 2 + (_SMALL > 0)).astype(np.int8)


def _evidence(same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the branch that was taken, and the gate; counts are whole numbers."""
    total = same + other
    if len(total) and total.max() >= len(_SMALL):
        return (np.log(same + PRIOR) - np.log(other + PRIOR)).astype(np.float32), _LEVELS[np.minimum(total, len(_SMALL) - 1).astype(np.int64)]
    same, other, total = same.astype(np.int64), other.astype(np.int64), total.astype(np.int64)
    return _LOGS[same] - _LOGS[other], _LEVELS[total]


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of log-odds in the refinement table: left step and share of the right one."""
    y = (np.clip(x, -8, 8) + 8) * ((STEPS - 1) / 16)
    left = np.minimum(y.astype(np.int64), STEPS - 2)
    return left, y - left


def _mixed(weights: np.ndarray, x: list[np.ndarray], gates: list[np.ndarray]) -> np.ndarray:
    return np.clip(sum(w[g] * v for w, v, g in zip(weights, x, gates)), -12, 12)


def start_weights(predictors: int) -> np.ndarray:
    out = np.full((predictors, GATES), 0.4)
    out[:, 0] = 0
    return out


def learn_online(weights: np.ndarray, hits: np.ndarray, x: list[np.ndarray], gates: list[np.ndarray], place: np.ndarray, times: np.ndarray) -> None:
    """Learn ``weights`` and count ``hits`` [place, step] from branches, run by run.

    Each run is predicted before it is learned.
    """
    for at in range(0, len(place), RUN):
        s = slice(at, at + RUN)
        mixed = _mixed(weights, [v[s] for v in x], [g[s] for g in gates])
        error = times[s] / (1 + np.exp(mixed))
        for k, (v, g) in enumerate(zip(x, gates)):
            weights[k] += RATE * np.bincount(g[s], error * v[s], GATES) / np.maximum(1, np.bincount(g[s], times[s], GATES)) ** 0.75
        weights[:, 0] = 0
        step = np.rint((np.clip(mixed, -8, 8) + 8) * ((STEPS - 1) / 16)).astype(np.int64)
        hits += np.bincount(place[s] * STEPS + step, times[s], hits.size).reshape(hits.shape)


def refined(hits: np.ndarray) -> np.ndarray:
    """The refinement table [place, step]: the share of hits, drawn to the mixed probability.

    A branch taken at some log-odds is one not taken at their negative.
    """
    even = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    return (hits + 40 * even) / (hits + hits[:, ::-1] + 40)


def gains(weights: np.ndarray, table: np.ndarray, x: list[np.ndarray], gates: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """log10 probability of each branch taken: half refined, half as mixed."""
    mixed = _mixed(weights, x, gates)
    left, share = _steps(mixed)
    p = 0.5 * (table[place, left] * (1 - share) + table[place, left + 1] * share) + 0.5 / (1 + np.exp(-mixed))
    return np.log10(np.clip(p, 1e-6, 1.0))


def _blob(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _merge_learned(df: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The weights and the refinement table that buckets (weights, hits, times) have learned."""
    weights, hits, total = np.zeros((shape[0], GATES)), np.zeros((shape[1], STEPS)), 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(shape[0] * GATES), np.zeros(shape[1] * STEPS), 0.0]
        for batch in batches:
            for w, h, t in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                sums = [sums[0] + t * np.frombuffer(w.as_buffer()), sums[1] + np.frombuffer(h.as_buffer()), sums[2] + t]
        yield pa.RecordBatch.from_arrays([pa.array([sums[0].tobytes()]), pa.array([sums[1].tobytes()]), pa.array([sums[2]])], names=["weights", "hits", "times"])

    for w, h, t in df.mapInArrow(add, "weights binary, hits binary, times double").collect():  # one small row a task
        weights += np.frombuffer(w).reshape(weights.shape)
        hits += np.frombuffer(h).reshape(hits.shape)
        total += t
    return (weights / total if total else start_weights(shape[0])), refined(hits)


# Spelling of new words


def spelled(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of some words, each with a space behind."""
    sizes = ends - starts + 1
    edge = np.cumsum(sizes)
    out = np.full(int(edge[-1]) if len(edge) else 0, SPACE, np.uint8)
    inside = np.ones(len(out), bool)
    inside[edge - 1] = False
    at = np.arange(len(out)) - np.repeat(edge - sizes, sizes) + np.repeat(starts, sizes)
    out[inside] = text[at[inside]]
    return out


def spelling_branches(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bit (0 or 1) of each branch of spelled words, eight for each byte, and the cell of each predictor."""
    n = len(data)
    ends = np.flatnonzero(data == SPACE)
    first = np.concatenate(([0], ends + 1))
    place = np.arange(n) - np.repeat(first[: len(ends)], np.diff(first))
    shift = np.arange(8)
    bit = ((data[:, None] >> (7 - shift)[None].astype(np.uint8)) & 1).ravel()
    node = ((np.int64(1) << shift)[None] | (data[:, None].astype(np.int64) >> (8 - shift)[None])).astype(np.uint32)
    context, cells = np.zeros(n, np.uint32), []
    for j in range(1, max(ORDERS) + 1):
        back = np.full(n, SPACE, np.uint32)
        back[j:] = data[:-j] if j < n else data[:0]
        back[place < j] = SPACE
        context = (context + back + np.uint32(j)) * np.uint32(0x85EBCA6B)
        context ^= context >> np.uint32(15)
        if j in ORDERS:
            h = (context[:, None] + node * np.uint32(0x9E3779B1)) * np.uint32(0xC2B2AE35)
            cells.append((h >> np.uint32(32 - SPELL_BITS)).astype(np.int64).ravel())
    return bit, cells


def _spelling_evidence(counts: np.ndarray, bit: np.ndarray, cells: list[np.ndarray], left_out: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    x, gates = [], []
    for k, c in enumerate(cells):
        v, g = _evidence(np.maximum(counts[k, bit, c] - left_out, 0), counts[k, 1 - bit, c])
        x.append(v)
        gates.append(g)
    return x, gates


def spelling_scores(model: dict, data: np.ndarray) -> np.ndarray:
    """log10 probability of each spelled word."""
    if not len(data):
        return np.zeros(0)
    bit, cells = spelling_branches(data)
    total = np.cumsum(gains(model["weights"], model["refined"], *_spelling_evidence(model["counts"], bit, cells, 0), np.tile(np.arange(8), len(data))))
    return np.diff(total[8 * np.flatnonzero(data == SPACE) + 7], prepend=0)


def _word_pieces(data: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Spelled words in runs of about ``most`` bytes."""
    ends = np.flatnonzero(data == SPACE) + 1
    at = 0
    while at < len(data):
        end = int(ends[max(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + most, "right") - 1)])
        yield data[at:end]
        at = end


def learn_spelling(words: DataFrame) -> dict:
    """The model of new words from the rows of ``words`` (spelled: binary)."""
    size = (len(ORDERS), 2, 1 << SPELL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint32)
        for batch in batches:
            for b in batch.column(0):
                for piece in _word_pieces(np.frombuffer(b.as_buffer(), np.uint8)):
                    bit, cells = spelling_branches(piece)
                    for k, c in enumerate(cells):
                        np.add.at(table[k].reshape(-1), bit.astype(np.int64) * size[2] + c, np.uint32(1))
        for k in range(size[0]):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[k].tobytes()], pa.binary())], names=["k", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << SPELL_BITS, np.int64)
        for batch in batches:
            for b in batch.column(1):
                total += np.frombuffer(b.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["k", "counts"])

    counts = np.zeros(size, np.float32)
    for k, b in words.mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").collect():  # the fixed-size table
        counts[k] = np.frombuffer(b, np.float32).reshape(size[1:])
    held = words.sparkSession.sparkContext.broadcast(counts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                weights, hits, total = start_weights(len(ORDERS)), np.zeros((8, STEPS)), 0
                for piece in _word_pieces(np.frombuffer(b.as_buffer(), np.uint8)):
                    bit, cells = spelling_branches(piece)
                    learn_online(weights, hits, *_spelling_evidence(held.value, bit, cells, 1), np.tile(np.arange(8), len(piece)), np.ones(len(bit)))
                    total += len(bit)
                yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([hits.tobytes()]), pa.array([float(total)])], names=["weights", "hits", "times"])

    weights, table = _merge_learned(words.mapInArrow(learn, "weights binary, hits binary, times double"), (len(ORDERS), 8))
    return {"counts": counts, "weights": weights, "refined": table}


# Words in the tree


def tree_counts(leaves: np.ndarray) -> list[np.ndarray]:
    """Counts of the nodes of each depth, from 0 to DEPTH."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append(out[-1].reshape(-1, 2).sum(1))
    return out[::-1]


def class_cell(classes: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
    """Cell of a class of the word before at the node of a given depth on the path to a leaf."""
    return (classes.astype(np.int64) << CLASS_DEPTH) | (1 << depth) | (word >> (DEPTH - depth))


def _branch(word: np.ndarray, depth: int) -> np.ndarray:
    return (word >> (DEPTH - 1 - depth)) & 1


def _leaf(pairs: np.ndarray) -> np.ndarray:
    return (pairs & np.uint64((1 << DEPTH) - 1)).astype(np.int64)


def _same_before(pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """[depth, pair]: training words on the pair's path at each depth, after the same word; pairs ascend."""
    out = np.empty((DEPTH + 1, len(pairs)), np.float32)
    for depth in range(DEPTH + 1):
        node = pairs >> np.uint64(DEPTH - depth)
        head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        out[depth] = np.repeat(np.add.reduceat(times, head), np.diff(np.append(head, len(pairs))))
    return out


def path_evidence(model: dict, pairs: np.ndarray, mine: np.ndarray, classes: np.ndarray, left_out: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log-odds and gates of each predictor for the branches [pair, depth] (flat) of distinct pairs."""
    word = _leaf(pairs)
    wide = (len(pairs), DEPTH)
    x, gates = [np.zeros(wide, np.float32) for _ in range(4)], [np.zeros(wide, np.int8) for _ in range(4)]
    for depth in range(DEPTH):
        bit = _branch(word, depth)
        node = (1 << depth) | (word >> (DEPTH - depth))
        tables = model["taken" if left_out else "odds"]
        counts = [None, _evidence(np.maximum(mine[depth + 1] - left_out, 0), mine[depth] - mine[depth + 1])]
        counts[0] = tuple(t[bit, node] for t in tables[0])
        if depth < CLASS_DEPTH:
            counts += [tuple(t[k, bit, class_cell((classes >> np.uint32(16 * k)) & np.uint32(0xFFFF), depth, word)] for t in tables[1]) for k in range(2)]
        for k, (v, g) in enumerate(counts):
            x[k][:, depth], gates[k][:, depth] = v, g
    return [v.ravel() for v in x], [g.ravel() for g in gates]


def _parts(pairs: np.ndarray, times: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of pairs with their counts ``_same_before``; counts are taken over whole lists of a word before."""
    before = pairs >> np.uint64(DEPTH)
    head = np.append(np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))), len(pairs)) if len(pairs) else np.zeros(1, np.int64)
    at = 0
    while at < len(head) - 1:
        end = max(at + 1, int(np.searchsorted(head, head[at] + most, "right")) - 1)
        a, b = int(head[at]), int(head[end])
        counts = _same_before(pairs[a:b], times[a:b])
        for i in range(a, b, most):
            yield slice(i, min(b, i + most)), counts[:, i - a : i - a + most]
        at = end


def path_scores(model: dict, pairs: np.ndarray, times: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 probability of the path of each pair."""
    out = np.zeros(len(pairs), np.float32)
    for s, mine in _parts(pairs, times):
        value = gains(model["weights"], model["refined"], *path_evidence(model, pairs[s], mine, classes[s], 0), np.tile(np.arange(DEPTH), s.stop - s.start))
        out[s] = value.reshape(-1, DEPTH).sum(1)
    return out


def pack(pairs: np.ndarray, times: np.ndarray, classes: np.ndarray) -> list[bytes]:
    """Ascending pairs (the word before and a leaf), their times and classes: before, kinds and sizes of lists, leaves, times.

    Times from 255 on stand apart, with their places.
    """
    before = pairs >> np.uint64(DEPTH)
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), before[1:] != before[:-1])))
    size, many = np.diff(np.append(head, len(pairs))), np.flatnonzero(times >= 255)
    lists = before[head].astype(np.uint32).tobytes() + classes[head].astype(np.uint32).tobytes() + size.astype(np.uint32).tobytes()
    return [lists, _leaf(pairs).astype(np.uint16).tobytes(), np.minimum(times, 255).astype(np.uint8).tobytes(), many.astype(np.int64).tobytes() + times[many].astype(np.int64).tobytes()]


def unpack(lists: bytes, leaves: bytes, times: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, times, classes) of ``pack``."""
    before, kinds, size = np.frombuffer(lists, np.uint32).reshape(3, -1)
    pairs = (np.repeat(before, size).astype(np.uint64) << np.uint64(DEPTH)) | np.frombuffer(leaves, np.uint16)
    place, value = np.frombuffer(many, np.int64).reshape(2, -1)
    count = np.frombuffer(times, np.uint8).astype(np.int64)
    count[place] = value
    return pairs, count, np.repeat(kinds, size)


def _odds(tree: list[np.ndarray], classes: np.ndarray, left_out: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Log-odds and gates [bit, node] of the tree and [k, bit, cell] of the classes, ``left_out`` less of the branch taken."""
    nodes = np.zeros((2, 1 << DEPTH))
    for depth in range(DEPTH):
        nodes[:, 1 << depth : 2 << depth] = tree[depth + 1].reshape(-1, 2).T
    both = []
    for counts in (nodes, classes):
        same, other = counts.reshape(-1, 2, counts.shape[-1]), counts.reshape(-1, 2, counts.shape[-1])[:, ::-1]
        v, g = _evidence(np.maximum(same - left_out, 0).ravel(), np.ascontiguousarray(other).ravel())
        both.append((v.reshape(counts.shape), g.reshape(counts.shape)))
    return tuple(both)


PACKED = ("lists", "leaves", "times", "many")


def learn_paths(merged: DataFrame, leaves: np.ndarray) -> dict:
    """The fixed-size part of the model of paths: node counts, class tables, weights and refinement."""
    spark = merged.sparkSession
    size = (2, 2, 1 << (CLASS_BITS + CLASS_DEPTH))
    blobs = merged.select(*PACKED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size)
        for batch in batches:
            for row in zip(*batch.columns):
                pairs, times, classes = unpack(*(c.as_buffer() for c in row))
                word = _leaf(pairs)
                for k in range(2):
                    mine = (classes >> np.uint32(16 * k)) & np.uint32(0xFFFF)
                    for depth in range(CLASS_DEPTH):
                        np.add.at(table[k].reshape(-1), _branch(word, depth) * size[2] + class_cell(mine, depth, word), times)
        for k in range(2):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[k].astype(np.int64).tobytes()], pa.binary())], names=["k", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size[1] * size[2], np.int64)
        for batch in batches:
            for b in batch.column(1):
                total += np.frombuffer(b.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["k", "counts"])

    tables = np.zeros(size, np.float32)
    for k, b in blobs.mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").collect():  # the fixed-size tables
        tables[k] = np.frombuffer(b, np.float32).reshape(size[1:])
    tree = tree_counts(leaves.astype(np.float64))
    model = {"leaves": leaves, "odds": _odds(tree, tables, 0)}
    held = spark.sparkContext.broadcast(model | {"taken": _odds(tree, tables, 1)})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                pairs, times, classes = unpack(*(c.as_buffer() for c in row))
                weights, hits = start_weights(4), np.zeros((DEPTH, STEPS))
                for s, mine in _parts(pairs, times):
                    x, gates = path_evidence(held.value, pairs[s], mine, classes[s], 1)
                    # A word that only this place has is spelled, not coded by its path.
                    known = (times[s] > 0) & (held.value["leaves"][_leaf(pairs[s])] > 1)
                    keep = np.repeat(known, DEPTH)
                    learn_online(weights, hits, [v[keep] for v in x], [g[keep] for g in gates], np.tile(np.arange(DEPTH), int(known.sum())), np.repeat(times[s][known], DEPTH))
                yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([hits.tobytes()]), pa.array([float(times.sum())])], names=["weights", "hits", "times"])

    weights, table = _merge_learned(blobs.mapInArrow(learn, "weights binary, hits binary, times double"), (4, DEPTH))
    return model | {"weights": weights, "refined": table}


# Chunks of documents


class Chunk:
    """The tokens of some texts: distinct words and pairs, ordered by bucket, and where they stand."""

    def __init__(self, table: pa.Table, n_words: int, n_pairs: int) -> None:
        hasher = WordHasher()
        hashes, starts, ends, texts, sizes, edges, base, size = [], [], [], [], [], [np.zeros(1, np.int64)], 0, 0
        for batch in table.to_batches():
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            h, s, edge = hasher(data, offsets)
            hashes.append(h)
            starts.append(s + size)
            ends.append(hasher.ends + size)
            texts.append(lower_table()[data])
            edges.append(edge[1:] + base)
            sizes.append(np.diff(offsets))
            base, size = base + len(h), size + len(data)
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        self.text, self.starts, self.ends, self.edge = join(texts, np.uint8), join(starts, np.int64), join(ends, np.int64), np.concatenate(edges)
        self.sizes, h = join(sizes, np.int64), join(hashes, np.uint64)
        del hasher, hashes, starts, ends, texts, sizes, edges  # what is done with goes at once, so that less is held at the peak
        # Words, ascending, so that their buckets are ranges of hashes.
        self.words, of = np.unique(h, return_inverse=True)
        self.word_of = of.astype(np.int32)
        del of
        self.first = np.zeros(len(self.words), np.int64)
        self.first[self.word_of[::-1]] = np.arange(len(h))[::-1]
        self.word_bucket = self.bucket_of(self.words, n_words)
        # Tokens: the words of each row and its end.
        rows = len(self.edge) - 1
        self.token_edge = self.edge + np.arange(rows + 1)
        self.is_end = np.zeros(len(h) + rows, bool)
        self.is_end[self.token_edge[1:] - 1] = True
        self.leaf = np.full(len(self.is_end), END >> (64 - DEPTH), np.int32)
        self.leaf[~self.is_end] = (h >> np.uint64(64 - DEPTH)).astype(np.int32)
        n_words_met = len(h)
        del h
        # What stands before a token: a distinct word, or the start; ordered by bucket.
        names = np.append(self.words, np.uint64(START))
        bucket, low = names % np.uint64(n_pairs), (names // np.uint64(n_pairs)) & np.uint64(0xFFFFFFFF)
        order = np.lexsort((low, bucket))
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        before = np.full(len(self.is_end), rank[-1], np.int64)
        # A word stands before the token that follows it; the last token of all is an end.
        before[1:][~self.is_end[:-1]] = rank[self.word_of]
        before[self.token_edge[:-1]] = rank[-1]
        kinds = np.zeros(len(names), np.uint32)
        if n_words_met:
            start, end = self.starts[self.first], self.ends[self.first]
            last, length = self.text[end - 1].astype(np.uint32), end - start
            ending = last * np.uint32(257) + self.text[np.maximum(end - 2, start)]
            opening = self.text[start].astype(np.uint32) * np.uint32(16) + np.minimum(length, 15).astype(np.uint32)
            squeeze = lambda v: (v * np.uint32(0x9E3779B1)) >> np.uint32(32 - CLASS_BITS)
            kinds[:-1] = squeeze(ending) | (squeeze(opening) << np.uint32(16))
        before <<= DEPTH
        before |= self.leaf
        found, of = np.unique(before, return_inverse=True)
        del before
        self.pair_of = of.astype(np.int32)
        of = order[found >> DEPTH]
        self.pairs = (low[of] << np.uint64(DEPTH)) | (found & ((1 << DEPTH) - 1)).astype(np.uint64)
        self.pair_bucket, self.classes = bucket[of].astype(np.int64), kinds[of]

    @staticmethod
    def bucket_of(words: np.ndarray, n: int) -> np.ndarray:
        return (((words >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def cuts(bucket: np.ndarray) -> list[tuple[int, slice]]:
        found, first = np.unique(bucket, return_index=True)
        return [(int(b), slice(int(i), int(j))) for b, i, j in zip(found, first, [*first[1:], len(bucket)])]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, vocabulary, base_score, score, bits_per_byte.

    ``docs`` has doc_id, text and training (boolean).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("training", F.lit(False)).alias("training"))
    size, n_training = docs.select(F.sum(F.octet_length("text")), F.count_if("training")).first()
    n_chunks, n_buckets = (max(1, -(-(size or 0) // b)) for b in (CHUNK_BYTES, BUCKET_BYTES))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        c = Chunk(table, n_buckets, n_buckets)
        training = np.array(table.column("training").to_pylist(), bool)
        words = np.bincount(c.word_of[np.repeat(training, np.diff(c.edge))], minlength=len(c.words))
        pairs = np.bincount(c.pair_of[np.repeat(training, np.diff(c.token_edge))], minlength=len(c.pairs))
        rows = []
        for b, s in c.cuts(c.word_bucket):
            once = np.flatnonzero(words[s] == 1) + s.start
            rare = spelled(c.text, c.starts[c.first[once]], c.ends[c.first[once]])
            rows.append((0, b, *_blob(c.words[s], rare, words[s].astype(np.int32)), b""))
        for b, s in c.cuts(c.pair_bucket):
            rows.append((1, b, *pack(c.pairs[s], pairs[s], c.classes[s])))
        columns = list(zip(*rows)) or [()] * 6
        types = {"kind": pa.int32(), "bucket": pa.int32()} | {k: pa.binary() for k in PACKED}
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(types.items(), columns)} | {"chunk": pa.array([key[0].as_py()] * len(rows), pa.int32())})

    asked = cut(dealt.groupBy("chunk").applyInArrow(ask, "kind int, bucket int, lists binary, leaves binary, times binary, many binary, chunk int"))
    words_asked = asked.where("kind = 0").select("bucket", "chunk", F.col("lists").alias("names"), F.col("leaves").alias("spelled"), "times")
    pairs_asked = asked.where("kind = 1").select("bucket", "chunk", *PACKED)

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable")
        words = [np.frombuffer(b, np.uint64) for b in pdf["names"]]
        names, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([np.frombuffer(b, np.int32) for b in pdf["times"]]), minlength=len(names)).astype(np.int64)
        found = np.split(total[place], np.cumsum([len(w) for w in words])[:-1])
        out = pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "counts": [c.astype(np.int64).tobytes() for c in found], "distinct": np.int64(0), "tokens": np.int64(0), "once": np.int64(0), "leaf": np.int64(0), "leaves": b"", "spelled": b""})
        leaf = (names >> np.uint64(64 - DEPTH)).astype(np.int64)
        rare = []
        for c, n, b in zip(found, pdf["times"], pdf["spelled"]):  # the words that training texts have once
            keep = c[np.frombuffer(n, np.int32) == 1] == 1
            data = np.frombuffer(b, np.uint8)
            edge = np.flatnonzero(data == SPACE) + 1
            rare.append(data[np.repeat(keep, np.diff(edge, prepend=0))])
        first = out.index[0]
        out.loc[first, ["distinct", "tokens", "once", "leaf"]] = [np.count_nonzero(total), total.sum(), np.count_nonzero(total == 1), leaf[0] if len(leaf) else 0]
        out.at[first, "leaves"] = np.bincount(leaf - leaf[0], total).astype(np.int64).tobytes() if len(leaf) else b""
        out.at[first, "spelled"] = np.concatenate(rare).tobytes()
        return out

    answers = cut(words_asked.groupBy("bucket").applyInPandas(answer, "chunk int, bucket int, counts binary, distinct long, tokens long, once long, leaf long, leaves binary, spelled binary"))
    distinct, tokens, once = answers.agg(F.sum("distinct"), F.sum("tokens"), F.sum("once")).first()
    n_all, n_distinct = (tokens or 0) + n_training, (distinct or 0) + (1 if n_training else 0)
    leaves = np.zeros(1 << DEPTH, np.int64)
    for at, b in answers.where("octet_length(leaves) > 0").select("leaf", "leaves").toLocalIterator():  # 2**DEPTH counts, and one more a bucket
        part = np.frombuffer(b, np.int64)
        leaves[at : at + len(part)] += part
    leaves[END >> (64 - DEPTH)] += n_training
    fresh = ((once or 0) + 0.5) / (n_all + 1)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable")
        parts = [unpack(*row) for row in zip(*(pdf[k] for k in PACKED))]
        every, first, place = np.unique(np.concatenate([p for p, _, _ in parts]), return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate([t for _, t, _ in parts]), minlength=len(every)).astype(np.int64)
        packed = pack(every, total, np.concatenate([c for _, _, c in parts])[first])
        return pd.DataFrame({"bucket": [key[0]]} | {k: [v] for k, v in zip(PACKED, packed)})

    merged = cut(pairs_asked.groupBy("bucket").applyInPandas(merge, "bucket int, lists binary, leaves binary, times binary, many binary"))
    paths = learn_paths(merged, leaves)
    spelling = learn_spelling(answers.where("octet_length(spelled) > 0").select("spelled"))
    held_paths, held = spark.sparkContext.broadcast(paths), spark.sparkContext.broadcast((spelling, leaves))

    def reply(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pairs, times, classes = unpack(*(known[k].iloc[0] for k in PACKED))
        value = np.rint(FINE * path_scores(held_paths.value, pairs, times, classes)).astype(np.int16)
        out = [value[np.searchsorted(pairs, unpack(lists, leaf, bytes(len(leaf) // 2), b"")[0])].tobytes() for lists, leaf in zip(pdf["lists"], pdf["leaves"])]
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "bucket": pdf["bucket"], "values": out})

    forget(spark)
    # Written, so that the requests' shuffle is gone before texts are dealt out again.
    gained = cut(pairs_asked.select("bucket", "chunk", "lists", "leaves").groupBy("bucket").cogroup(merged.groupBy("bucket")).applyInPandas(reply, "chunk int, kind int, bucket int, values binary"))
    forget(spark)
    replies = gained.unionByName(answers.select("chunk", F.lit(0).alias("kind"), "bucket", F.col("counts").alias("values")))

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        spelling, leaves = held.value
        c = Chunk(table, n_buckets, n_buckets)
        del c.pairs, c.pair_bucket, c.classes, c.word_bucket
        parts = sorted(zip(*(replies.column(k).to_pylist() for k in ("kind", "bucket", "values"))))
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v, np.int64) for kind, _, v in parts if kind == 0)])
        paths = np.concatenate([np.zeros(0, np.int16), *(np.frombuffer(v, np.int16) for kind, _, v in parts if kind == 1)]) / FINE
        del parts, replies
        new = np.flatnonzero(counts == 0)
        cost = np.zeros(len(counts))
        cost[new] = np.concatenate([np.zeros(0), *(spelling_scores(spelling, p) for p in _word_pieces(spelled(c.text, c.starts[c.first[new]], c.ends[c.first[new]])))])
        del c.text, c.starts, c.ends, c.first
        n = counts[c.word_of]

        def total(v: np.ndarray, edge: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(v) + 1)
            np.cumsum(v, out=sums[1:])
            return np.diff(sums[edge])

        n_tokens = np.diff(c.token_edge)
        base = total(np.log10(n + 1.0), c.edge) + math.log10(n_training + 1) - n_tokens * math.log10(n_all + n_distinct + 1)
        of_token = np.full(len(c.leaf), n_training, np.int64)
        of_token[~c.is_end] = n
        del n
        known = of_token > 0
        value = np.zeros(len(c.leaf))
        value[~c.is_end] = cost[c.word_of]
        if not n_training:
            value[c.is_end] = spelling_scores(spelling, np.full(1, SPACE, np.uint8))[0]
        at = np.flatnonzero(known)
        value[at] = paths[c.pair_of[at]] + np.log10(of_token[at] / leaves[c.leaf[at]])
        value += np.where(known, math.log10(1 - fresh), math.log10(fresh))
        mixed = total(value, c.token_edge)
        size_of = c.sizes
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "training": table.column("training"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(total(known, c.token_edge).astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(len(mixed), n_all), pa.int64()),
                "vocabulary": pa.array(np.full(len(mixed), n_distinct), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(mixed),
                "bits_per_byte": pa.array(-mixed / math.log10(2) / np.maximum(1, size_of)),
            }
        )

    schema = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)
