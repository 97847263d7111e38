"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are word sequences (A-Z lower-cased, punctuation at the end of words ignored).  A
document leaks an item when some run of its words is within ``floor(most_edits * n)`` word edits of
the item's ``n`` words.

So many edits leave a run of ``SEED`` words of the item whole (or the bound is lowered until they
do), so every leak has an item-sized window that begins where such a shared run puts it.  These
windows and the items are embedded by CGK random walks: a walk steps through 3n places, emits the
word at its pointer, and moves the pointer on or not by a random bit of the place and the word, so
that close sequences give strings of small Hamming distance.  Each of several walks is sampled at a
few places for each of several tables.  A window and its item are compared exactly (word edit
distance of the item to the best run in the window, widened by the bound) if they agree in one table
or share as many runs of ``SEED`` words, each no more than the bound off its place, as a leak must:
an edit breaks ``SEED`` of them at most.  So the walks' recall, which falls with the number of edits,
doesn't limit what is found: the target recall is 1 at any length and bound.

The benchmark is worked through in blocks of bounded size.  Defined results: null or empty texts and
items leak nothing; items with equal words are found each, those without an id under a null id; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, mix, slices, text_buffer

MOST_EDITS = 0.2
SEED = 3
#: Walks, tables of each and sampled places: two strings that differ in half their places agree in
#: a table with probability 1/4, in none of the 24 with 0.001.
WALKS, TABLES, PLACES = 3, 8, 2
#: Bytes of benchmark text that are broadcast at a time.
BLOCK_BYTES = 16 << 20
PUNCTUATION = b".,;:!?\"')]}*#$%&"


class LooseHasher(WordHasher):
    """Word hashes that take no notice of punctuation at the end."""

    def __init__(self) -> None:
        super().__init__()
        self.values[list(PUNCTUATION)] = 0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As in ``WordHasher``; the hash is of the bytes before the trailing punctuation."""
        punct = np.zeros(256, bool)
        punct[list(PUNCTUATION)] = True
        lone = punct[data]
        if lone.any():
            follows = np.ones(len(data), bool)
            follows[:-1] = self.space[data[1:]]
            starts = offsets[1:-1]
            follows[starts[(starts > 0) & (starts < len(data))] - 1] = True
            data = data.copy()
            for _ in range(8):  # trailing marks become spaces from the end on
                gone = lone & follows
                if not gone.any():
                    break
                data[gone] = 32
                lone &= ~gone
                follows[:-1] |= gone[1:]
        return super().__call__(data, offsets)


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Symbols that one walk emits in its first ``steps`` steps: a row for each step, a column for each window."""
    at = starts.copy()
    out = np.zeros((steps, len(starts)), np.uint64)
    for step in range(steps):
        inside = at < ends
        symbol = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        out[step] = symbol
        bit = mix(symbol ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)
        at = at + (inside & (bit == 1))
    return out


def places(n: int, seed: int) -> np.ndarray:
    """The sampled steps of one walk for items of n words: tables x places.

    Only the first half of the 3n steps is sampled, where pointers have not yet run out of words.
    """
    return np.random.default_rng([seed, n]).integers(0, -(-3 * n // 2), (TABLES, PLACES))


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edits between the item and any run of the text, and where such a run ends."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    best = min(row)
    return best, row.index(best)


def _runs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal values: the value and its places."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    for place in np.split(np.arange(len(values)), cuts):
        yield int(values[place[0]]), place


class Items:
    """A block of items: words, seeds, how many of them a leak must have, and sampled embeddings."""

    def __init__(self, ids: list[int], texts: list[str | None], most_edits: float) -> None:
        hasher = LooseHasher()
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        words, _, edge = hasher(data, offsets)
        self.ids, self.words, self.bound, self.least, self.samples = [], [], [], [], []
        seeds: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(ids, edge[:-1].tolist(), edge[1:].tolist()):
            w = words[a:b]
            n = len(w)
            if n == 0:
                continue
            q = min(SEED, n)
            k = max(0, min(int(most_edits * n), -(-(n - q + 1) // q) - 1))
            number = len(self.ids)
            self.ids.append(i)
            self.words.append(w)
            self.bound.append(k)
            self.least.append(n - q + 1 - k * q)
            self.samples.append([walk(w, np.zeros(1, np.int64), np.array([n]), -(-3 * n // 2), s)[:, 0][places(n, s)] for s in range(WALKS)])
            for o in range(n - q + 1):
                seeds.setdefault(self._seed(w[o : o + q]), []).append((number, o))
        self.short = sorted({min(SEED, len(w)) for w in self.words})
        self.seeds = {h: np.array(v, np.int64) for h, v in seeds.items()}
        self.names = np.array(sorted(self.seeds), np.uint64)

    @staticmethod
    def _seed(words: np.ndarray) -> int:
        h = np.full(1, len(words), np.uint64)
        for w in words:
            h = mix(h * np.uint64(3) + w)
        return int(h[0])

    @staticmethod
    def seed_hashes(words: np.ndarray, q: int) -> np.ndarray:
        h = np.full(max(0, len(words) - q + 1), q, np.uint64)
        for i in range(q):
            h = mix(h * np.uint64(3) + words[i : len(words) - q + 1 + i])
        return h

    def find(self, words: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, edits): the closest run of each item that a row leaks."""
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q in self.short:
            h = self.seed_hashes(words, q)
            if not len(h) or not len(self.names):
                continue
            at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
            found = np.flatnonzero(self.names[at] == h)
            row = np.searchsorted(edge, found, "right") - 1
            found, row = found[found + q <= edge[row + 1]], row[found + q <= edge[row + 1]]
            if not len(found):
                continue
            lists = [self.seeds[int(x)] for x in h[found]]
            times = [len(x) for x in lists]
            every = np.concatenate(lists)
            hits.append((np.repeat(row, times), every[:, 0], np.repeat(found, times) - every[:, 1]))
        if not hits:
            return
        row, item, start = (np.concatenate(x) for x in zip(*hits))
        (row, item, start), times = np.unique(np.stack([row, item, start]), axis=1, return_counts=True)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        sizes = np.array([len(w) for w in self.words])[item]
        lo, hi = np.maximum(start, edge[row]), np.minimum(start + sizes, edge[row + 1])
        order = np.argsort(item, kind="stable")
        names, first = np.unique(item[order], return_index=True)
        groups = list(zip(names.tolist(), np.split(order, first[1:])))
        bound, least = np.array(self.bound)[item], np.array(self.least)[item]
        pair = np.cumsum(np.concatenate(([0], (np.diff(row) != 0) | (np.diff(item) != 0))))
        place = start - start.min() + pair * (int(np.ptp(start)) + 2 * int(bound.max()) + 2)
        runs = np.concatenate(([0], np.cumsum(times)))
        near = runs[np.searchsorted(place, place + bound, "right")] - runs[np.searchsorted(place, place - bound)] >= least
        for at in range(0, len(order), 4096):  # windows are walked together, whatever their item
            some = order[at : at + 4096]
            for s in range(WALKS):
                emitted = walk(words, lo[some], hi[some], -(-3 * int(sizes[some].max()) // 2), s)
                for number, group in _runs(item[some]):
                    mine = emitted[places(len(self.words[number]), s)][:, :, group]
                    near[some[group]] |= (mine == self.samples[number][s][:, :, None]).all(1).any(0)
        for number, group in groups:
            w, k = self.words[number], self.bound[number]
            n, target = len(w), w.tolist()
            for g in group[near[group]].tolist():
                r = int(row[g])
                a, b = max(int(edge[r]), int(lo[g]) - k), min(int(edge[r + 1]), int(hi[g]) + k)
                if np.count_nonzero(np.isin(w, words[a:b])) < n - k:
                    continue  # every word that is missing is an edit
                edits, end = edit_distance(target, words[a:b].tolist())
                if edits <= k:
                    key, value = (r, number), (edits, max(0, a + end - n - int(edge[r])))
                    best[key] = min(best.get(key, value), value)
        for (r, number), (edits, at) in sorted(best.items()):
            yield r, number, at, edits


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits): each document with each item that it leaks."""
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text", F.octet_length("text").cast("long").alias("size"))
    total = items.agg(F.sum("size")).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    out = None
    for block in range(n_blocks):  # a stated set of queries, in blocks of bounded size
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).select("item_id", "text").collect()
        held = spark.sparkContext.broadcast((sorted(((r[0], r[1]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])), most_edits))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pairs, edits_bound = held.value
            block_items, hasher = Items([p[0] for p in pairs], [p[1] for p in pairs], edits_bound), LooseHasher()
            for batch in batches:
                for rows in slices(batch, "text", 2 << 20):
                    data, offsets = text_buffer(rows.column(1))
                    words, _, edge = hasher(data, offsets)
                    found = list(block_items.find(words, edge)) if len(words) else []
                    doc = rows.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc[r] for r, *_ in found], pa.int64()),
                            pa.array([block_items.ids[i] for _, i, *_ in found], pa.int64()),
                            pa.array([at for *_, at, _ in found], pa.int64()),
                            pa.array([len(block_items.words[i]) for _, i, *_ in found], pa.int64()),
                            pa.array([e for *_, e in found], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "first_word", "n_words", "edits"],
                    )

        leaks = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, edits long")
        out = leaks if out is None else out.unionByName(leaks)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """The rows of ``docs`` that leak no item (rows without doc_id stay)."""
    bad = find_leaks(docs, benchmark, most_edits).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
