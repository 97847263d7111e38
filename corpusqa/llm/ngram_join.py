"""N-gram Jaccard join with grouped prefixes.

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles.  Two documents link
when ``den * |intersection| >= num * |union|``; ``link_components`` gives each document the smallest
doc_id that it reaches by links.  The steps:

1. Equal sets are one class.  Shingles are ordered by how far their count stands out (counts in a
   table of fixed size, so that a chance meeting only changes the order), then by how frequent their
   words are, the rarest first.  Linked sets share a shingle among the first
   ``n - ceil(n * num / den) + 1`` of each, its prefix.
2. Classes with the same prefix and size are one group.  Groups meet in buckets of prefix
   shingles; pairs that sizes and places rule out are dropped.  A pair need be found at the first
   shingle that both have only, so that places before it are misses on both sides.
3. Group pairs are expanded to class pairs; a parity sketch bounds the symmetric difference, the
   sets themselves decide.
4. Where a shingle would give very many pairs, its groups of like size (bands of sizes, two at a time)
   form a cluster, as large groups do.  A cluster takes the prefix join once more, to its centre: the
   shingles that most of a few members have.  With the differences ``dx``, ``dy`` to the centre a pair
   links when the slacks, ``(den - num) * n - (num + den) * |d|`` of each, and
   ``2 * (num + den) * |dx & dy|`` sum up to 0 at least.  So all whose slack suffices link with the
   member of the largest slack, unseen; the others need differences in common, and meet by prefixes of
   these.  What crowds there forms smaller clusters: no difference is one that most members have.

No pair is dropped but by an exact bound.  Defined results: null or empty text has no shingles and
no links, its component is its doc_id; rows with the same doc_id are apart but share the id; rows
without doc_id get a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, cut, grams, mix, partitions, slices, text_buffer
from .components import components

#: Bits of the tables of shingle and word counts that order shingles.
CELL_BITS, WORD_BITS = 22, 18
#: Pieces of either table.  A task of the scan sends one of each, which the piece's group holds together.
_SEGMENTS = 512
#: Bytes of text that a task turns into shingles at a time, and hashes at a time; workers keep what they once took.
TEXT, PIECE = 1 << 21, 1 << 18
#: Postings that a task deals out to buckets at a time, and those that a bucket has, about.
POSTED = 1 << 18
#: From so many groups in one shingle's list and so many pairs for each of them, they form a cluster.
CROWD, DENSE = 64, 32
#: Members of a group up to which its pairs are expanded.
FEW = 12
#: Members that name a cluster's centre, members compared with it in one task.
SAMPLE, SHARE = 32, 128
#: Clusters within clusters; beyond, all pairs that the filters leave are compared.
LEVELS = 8
#: Least bits of a parity sketch; a larger set has a bit for each shingle at least.
SKETCH_BITS = 512


def _sets(batch: pa.RecordBatch, at: int, k: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The ascending shingle hashes of each row."""
    data, offsets = text_buffer(batch.column(at))
    h, _, words = hasher(data, offsets)
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        yield np.unique(grams(h[a:b], k))


def shingle_order(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables that order shingles: steps by which a cell's count stands out, costs of a word's cell.

    Both have a fixed size.  Counts of one task stop at 65535, which only changes the order.
    """
    wide = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(PIECE)
        cells, words = np.zeros(wide, np.uint32), np.zeros(1 << WORD_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text", TEXT):
                h, _, _ = hasher(*text_buffer(part.column(0)))
                np.add.at(words, (h >> np.uint64(64 - WORD_BITS)).view(np.int64), np.uint32(1))
                np.add.at(cells, (grams(h, k) >> np.uint64(64 - CELL_BITS)).view(np.int64), np.uint32(1))
        for base, table in ((0, cells), (_SEGMENTS, words)):
            names = np.arange(base, base + _SEGMENTS, dtype=np.int32)
            packed = [np.minimum(piece, 65535).astype(np.uint16).tobytes() for piece in np.split(table, _SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], names=["g", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(b.as_buffer(), np.uint16).astype(np.int64) for batch in batches for b in batch.column(1))
        level = np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["g", "level", "total"])

    rows = docs.select("text").mapInArrow(count, "g int, counts binary").groupBy("g").applyInArrow(add, "g int, level binary, total long").collect()
    rows.sort()
    if not rows:
        return np.zeros(wide, np.int16), np.zeros(1 << WORD_BITS, np.int16)
    mean = sum(r[2] for r in rows[:_SEGMENTS]) / wide
    cells, words = (np.frombuffer(b"".join(r[1] for r in part), np.uint8) / 8.0 for part in (rows[:_SEGMENTS], rows[_SEGMENTS:]))
    # A count of twice the mean is no news: so much comes of shingles that share a cell.
    steps = np.maximum(0, np.ceil(cells - math.log2(2 * max(mean, 0.5) + 1.5))).astype(np.int16)
    return steps, np.round(2 * words).astype(np.int16)


def _packed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digest of the set, digest of its prefix, prefix and parity sketch of every document."""
    tables = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(PIECE)
        steps, costs = tables.value
        for batch in batches:
            for part in slices(batch, "text", TEXT):
                n, digest, group, prefix, sketch = [], [], [], [], []
                h, _, words = hasher(*text_buffer(part.column(1)))
                cost = np.concatenate(([0], np.cumsum(costs[(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)], dtype=np.int64)))
                for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
                    s, first = np.unique(grams(h[a:b], k), return_index=True)
                    m = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    first += a
                    rank = steps[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)] * 1024 + np.minimum(1023, cost[np.minimum(first + k, b)] - cost[first])
                    n.append(len(s))
                    digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                    prefix.append(s[np.argsort(rank.astype(np.uint16), kind="stable")[:m]].tobytes())
                    group.append(blake2b(prefix[-1], digest_size=16).digest())
                    bits = max(SKETCH_BITS, 1 << max(0, len(s) - 1).bit_length())
                    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    sketch.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(group, pa.binary()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "digest", "head", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, digest binary, head binary, prefix binary, sketch binary")


def _posted(token: np.ndarray, n_buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket of tokens: the rest of each token and the columns beside it, packed."""
    bucket = (token % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    cuts = np.split(order, first[1:]) if len(order) else []
    packed = {"low": (token // np.uint64(n_buckets)).astype(np.uint32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([v[c].tobytes() for c in cuts], pa.binary()) for v in packed.values())], names=["bucket", *packed])


def _buckets(postings: Column, rows: DataFrame) -> int:
    """Buckets for so many postings of all ``rows``: at least four for each shuffle partition, so that no session's number of these makes them large."""
    total = rows.agg(F.sum(postings)).first()[0] or 0
    return max(4 * partitions(rows.sparkSession), -(-total // POSTED))


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows with at most POSTED postings (a row with more is alone)."""
    edge = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + POSTED, "right")) - 1)
        yield slice(at, end)
        at = end


def _lists(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal tokens."""
    head = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(low)))


def _steps_of(small: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs in the small lists, by their distance."""
    for step in range(1, CROWD):
        j = np.flatnonzero(small & (place >= step))
        if not len(j):
            return
        yield j - step, j


def _windows(n: np.ndarray, num: int, den: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j < the last of like size, of a list ascending by size; i below ``most``."""
    times = (np.searchsorted(n, n * den // num, "right") - np.arange(len(n)) - 1)[:most]
    edge = np.concatenate(([0], np.cumsum(times)))
    at = 0
    while at < most:
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + (1 << 20), "right")) - 1)
        i = np.repeat(np.arange(at, end), times[at:end])
        yield i, i + 1 + np.arange(len(i)) - (edge[i] - edge[at])
        at = end


def _pairs(left: list[np.ndarray], right: list[np.ndarray], keys: list[np.ndarray], members: list[np.ndarray]) -> pd.DataFrame:
    """Rows (crowd, a, b): pairs, the smaller first, and members b of the cluster a."""
    a, b, key, member = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, keys, members))
    crowd = np.repeat([False, True], [len(a), len(key)])
    return pd.DataFrame({"crowd": crowd, "a": np.concatenate((np.minimum(a, b), key)), "b": np.concatenate((np.maximum(a, b), member))}).drop_duplicates()


def _meet(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(crowd, a, b): pairs of groups that may link, and groups b of a cluster a."""
    groups = groups.where("n > 0")
    n_buckets = _buckets(F.expr(f"n - (n * {num}L + {den - 1}) div {den} + 1"), groups)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for some in _runs(pc.binary_length(batch.column(2)).to_numpy() // 8):
                prefix = [np.frombuffer(b, np.uint64) for b in batch.column(2)[some].to_pylist()]
                sizes = np.array([len(p) for p in prefix])
                which = np.repeat(np.arange(len(prefix)), sizes)
                rank = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield _posted(np.concatenate(prefix), n_buckets, {"gid": gid[some][which], "n": n[some][which].astype(np.int32), "rank": rank.astype(np.int32)})

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        column = lambda k, t: np.concatenate([np.frombuffer(b, t) for b in pdf[k]])
        low, gid, n, rank = column("low", np.uint32), column("gid", np.int64), column("n", np.int32).astype(np.int64), column("rank", np.int32).astype(np.int64)
        order = np.lexsort((gid, n, low))
        low, gid, n, rank = low[order], gid[order], n[order], rank[order]
        head, length = _lists(low)
        left, right, keys, members = [], [], [], []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            # All before the first common shingle is missing on the other side.
            need = -(-num * (n[i] + n[j]) // (num + den))
            ok = (den * n[i] >= num * n[j]) & (np.minimum(n[i] - rank[i], n[j] - rank[j]) >= need) & (gid[i] != gid[j])
            left.append(gid[i[ok]])
            right.append(gid[j[ok]])

        for i, j in _steps_of(np.repeat(length < CROWD, length), np.arange(len(low)) - np.repeat(head, length)):
            take(i, j)
        for a, size in zip(head[length >= CROWD].tolist(), length[length >= CROWD].tolist()):
            sizes = n[a : a + size]
            band = np.floor(np.log(sizes) / (math.log(den / num) * (1 + 1e-9))).astype(np.int64)
            first = np.flatnonzero(np.diff(band, prepend=-1))
            for at in first.tolist():  # linked sets are of one band or of two that follow each other
                own, end = (int(np.searchsorted(band, band[at] + x, "right")) for x in (0, 1))
                some = sizes[at:end]
                if np.sum(np.searchsorted(some, some * den // num, "right") - np.arange(len(some))) > DENSE * len(some) and len(some) >= CROWD:
                    names = gid[a + at : a + end]
                    keys.append(np.full(len(names), names.min()))
                    members.append(names)
                else:
                    for i, j in _windows(some, num, den, own - at):
                        take(i + a + at, j + a + at)
        return _pairs(left, right, keys, members)

    posted = groups.select("gid", "n", "prefix").mapInArrow(post, "bucket int, low binary, gid binary, n binary, rank binary")
    return posted.groupBy("bucket").applyInPandas(pair, "crowd boolean, a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return den * inter >= num * (len(x) + len(y) - inter)


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents named in ``ids`` (one row for an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(PIECE)
        for batch in batches:
            for part in slices(batch, "text", TEXT):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in _sets(part, 1, k, hasher)], pa.binary())], names=["id", "set"])

    return docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "id long, set binary")


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two parity sketches differ; the longer one is folded to the shorter."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _may_link(pairs: DataFrame, packed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sketches don't rule out: sets differ in no fewer shingles than their sketches in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            apart = np.array([_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            ok = apart * (den + num) <= (n.astype(np.int64) + m) * (den - num)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    of = lambda c: packed.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(batch.column(2), batch.column(3))]
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def _compared(clusters: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, id) of clusters against their centres: (key, share, id, slack, difference) and (key, share, top, most)."""
    sized = cut(clusters.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    dealt = clusters.join(sized, "key").withColumn("hash", F.xxhash64("id"))
    sample = dealt.where(F.pmod("hash", F.ceil(F.col("size") / SAMPLE)) == 0).select("key", "id").join(sets, "id")

    def majority(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, times = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["set"]]), return_counts=True)
        return pd.DataFrame({"key": [key[0]], "centre": [name[2 * times > len(pdf)].tobytes()]})

    centres = sample.groupBy("key").applyInPandas(majority, "key long, centre binary")
    shares = sized.select("key", F.explode(F.expr(f"sequence(0L, (size - 1) div {SHARE})")).alias("share"))
    centres = shares.join(centres, "key", "left")
    rows = dealt.select("key", F.pmod(F.xxhash64("hash"), F.expr(f"1 + (size - 1) div {SHARE}")).alias("share"), "id").join(sets, "id")

    def compare(key: tuple, pdf: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        held = centre["centre"].iloc[0] if len(centre) else None
        c = np.frombuffer(held or b"", np.uint64)
        slack, difference = [], []
        for b in pdf["set"]:
            s = np.frombuffer(b, np.uint64)
            added, missing = np.setdiff1d(s, c, assume_unique=True), np.setdiff1d(c, s, assume_unique=True)
            slack.append((den - num) * len(s) - (num + den) * (len(added) + len(missing)))
            difference.append(added.tobytes() + missing.tobytes())  # one order for all: what is missing comes last
        return pd.DataFrame({"key": key[0], "share": key[1], "id": pdf["id"], "slack": slack, "difference": difference})

    found = cut(rows.groupBy("key", "share").cogroup(centres.groupBy("key", "share")).applyInPandas(compare, "key long, share long, id long, slack long, difference binary"))
    top = found.groupBy("key").agg(F.max(F.struct("slack", "id")).alias("top"))
    return found, cut(shares.join(top, "key").select("key", "share", F.col("top.id").alias("top"), F.col("top.slack").alias("most")))


def _meet_apart(rows: DataFrame, n_buckets: int, num: int, den: int, last: bool) -> DataFrame:
    """As ``_meet`` for members (key, id, slack, difference, most): pairs with one at least that its cluster's top does not link."""
    unit = 2 * (num + den)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _runs(pc.binary_length(batch.column(3)).to_numpy() // 8):
                key, id_, slack, most = (batch.column(i)[some].to_numpy() for i in (0, 1, 2, 4))
                d = [np.frombuffer(b, np.uint64) for b in batch.column(3)[some].to_pylist()]
                size = np.array([len(x) for x in d], np.int64)
                apart = slack + most < 0
                # What a partner must have in common: one of any slack, or one that is apart.
                least = np.where(apart, np.maximum(1, -((slack + most) // unit)), -((slack - most - 1) // unit))
                times = np.maximum(0, size - least + 1)
                if not times.sum():
                    continue
                which = np.repeat(np.arange(len(d)), times)
                place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                token = mix(np.concatenate([x[:t] for x, t in zip(d, times.tolist())]) ^ mix(key.astype(np.uint64))[which])
                yield _posted(token, n_buckets, {"id": id_[which], "slack": slack[which], "size": size[which].astype(np.int32), "place": place.astype(np.int32), "apart": apart[which]})

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        column = lambda k, t: np.concatenate([np.frombuffer(b, t) for b in pdf[k]])
        low, id_, slack, apart = column("low", np.uint32), column("id", np.int64), column("slack", np.int64), column("apart", bool)
        rest = column("size", np.int32).astype(np.int64) - column("place", np.int32)
        order = np.lexsort((id_, ~apart, low))
        low, id_, slack, apart, rest = low[order], id_[order], slack[order], apart[order], rest[order]
        head, length = _lists(low)
        alone = np.add.reduceat(apart, head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)
        left, right, keys, members = [], [], [], []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            both = slack[i] + slack[j]
            ok = (both < 0) & (np.minimum(rest[i], rest[j]) >= -(both // unit)) & (apart[i] | apart[j]) & (id_[i] != id_[j])
            left.append(id_[i[ok]])
            right.append(id_[j[ok]])

        small = (length < CROWD) & (alone > 0)
        for i, j in _steps_of(np.repeat(small, length), np.arange(len(low)) - np.repeat(head, length)):
            take(i, j)
        for a, size, odd in zip(*(x[(length >= CROWD) & (alone > 0)].tolist() for x in (head, length, alone))):
            if odd > DENSE and not last:
                keys.append(np.full(size, id_[a : a + size].min()))
                members.append(id_[a : a + size])
            else:
                for i in range(a, a + odd):
                    j = np.arange(i + 1, a + size)
                    take(np.full(len(j), i), j)
        return _pairs(left, right, keys, members)

    posted = rows.select("key", "id", "slack", "difference", "most").mapInArrow(post, "bucket int, low binary, id binary, slack binary, size binary, place binary, apart binary")
    return posted.groupBy("bucket").applyInPandas(pair, "crowd boolean, a long, b long").distinct()


def _cluster_links(clusters: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links that connect members (key, id) of clusters, and pairs that may link besides."""
    links, pairs = [], []
    for level in range(LEVELS):
        if clusters.isEmpty():
            break
        found, tops = _compared(clusters, sets, num, den)
        rows = found.join(tops, ["key", "share"])
        links.append(rows.where("slack + most >= 0 AND id <> top").select(F.col("id").alias("a"), F.col("top").alias("b")))
        unsure = rows.where("slack + most < 0").select("key").distinct()
        n_buckets = _buckets(F.expr("octet_length(difference) div 8"), found)
        met = cut(_meet_apart(rows.join(unsure, "key", "left_semi"), n_buckets, num, den, level == LEVELS - 1))
        pairs.append(met.where("NOT crowd").select("a", "b"))
        clusters = met.where("crowd").select(F.col("a").alias("key"), F.col("b").alias("id"))
    return links, pairs


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def link_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = cut(_packed(docs, k, num, den))
    # A class is named by its smallest doc_id; an id that several rows have is no proof of equal sets.
    unique = packed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    shared = packed.join(unique, "doc_id", "left_semi").where("n > 0")
    if not shared.isEmpty():
        return _with_shared_ids(docs, k, num, den)
    known = packed.where("n > 0 AND doc_id IS NOT NULL")
    # Written first: a digest that very many rows have is then met in a join that can be split.
    classes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "class_id"))
    placed = cut(packed.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).alias("class_id")))
    # Ids that stand for nothing more are few or written apart, so that prefixes and sketches needn't be moved to leave them out.
    copies = cut(placed.where("class_id <> doc_id").select("doc_id"))
    heads = known.select("doc_id", "n", "head").join(copies, "doc_id", "left_anti")
    grouped = heads.groupBy("n", "head").agg(F.min("doc_id").alias("gid"), F.count(F.lit(1)).alias("members")).where("members > 1")
    member = cut(heads.join(cut(grouped), ["n", "head"]).select(F.col("doc_id").alias("id"), "gid", "members"))
    apart = cut(copies.unionByName(member.where("id <> gid").select(F.col("id").alias("doc_id"))))
    met = cut(_meet(known.join(apart, "doc_id", "left_anti").select(F.col("doc_id").alias("gid"), "n", "prefix"), num, den))
    small, many = member.where(F.col("members") <= FEW).select("gid", "id"), member.where((F.col("members") > FEW) & (F.col("id") == F.col("gid"))).select("gid")
    # Pairs with a large group go to its cluster, those of small ones are expanded.
    flagged = met.where("NOT crowd").join(many.select(F.col("gid").alias("a"), F.lit(True).alias("big_a")), "a", "left").join(many.select(F.col("gid").alias("b"), F.lit(True).alias("big_b")), "b", "left")
    flagged = cut(flagged.select("a", "b", F.when(F.col("big_a"), F.col("a")).when(F.col("big_b"), F.col("b")).alias("key")))
    between = flagged.where("key IS NULL").join(small.select(F.col("gid").alias("a"), F.col("id").alias("x")), "a", "left").join(small.select(F.col("gid").alias("b"), F.col("id").alias("y")), "b", "left")
    within = small.select("gid", F.col("id").alias("a")).join(small.select("gid", F.col("id").alias("b")), "gid").where("a < b").select("a", "b")
    pairs = [between.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), within]
    pair_of = flagged.where("key IS NOT NULL").select("key", F.explode(F.array("a", "b")).alias("gid"))
    clusters = met.where("crowd").select(F.col("a").alias("key"), F.col("b").alias("gid")).unionByName(pair_of).unionByName(many.select(F.col("gid").alias("key"), "gid"))
    clusters = cut(clusters.join(member.select("gid", "id"), "gid", "left").select("key", F.coalesce("id", "gid").alias("id")).distinct())
    links: list[DataFrame] = []
    if not clusters.isEmpty():
        links, more = _cluster_links(clusters, cut(_sets_of(docs, cut(clusters.select("id").distinct()), k)), num, den)
        pairs += more
    likely = cut(_may_link(_all(pairs).distinct(), known, num, den))
    wanted = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links.append(_verify(likely, cut(_sets_of(docs, wanted, k)), num, den))
    found = components(_all(links))
    named = placed.join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def _with_shared_ids(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """As above where several rows have one doc_id: rows are numbered, ids put back.

    A component is named by the smallest doc_id among its rows.
    """
    numbered = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    found = cut(link_components(numbered.select(F.col("row").alias("doc_id"), "text"), k, num, den))
    named = numbered.select(F.col("row"), "doc_id").join(found.withColumnRenamed("doc_id", "row"), "row")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component_id").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))
