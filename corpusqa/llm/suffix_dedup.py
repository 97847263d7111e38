"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

A byte is removed when a string of ``width`` bytes covers it that also starts in a document with a
smaller doc_id.  The steps:

1. Texts are dealt out to chunks.  Each chunk names the anchors of its texts: the least hash of the
   ``ANCHOR``-byte strings in each window of ``width`` bytes.  Equal windows have equal anchors.
2. Buckets of anchors report those that more than one text has (nothing else can repeat), and
   whether all stretches of windows under it are equal.
3. Each chunk sends the stretches under such an anchor (equal ones once, with the places where they
   occur) to the anchor's bucket, with their bytes where stretches differ.
4. Where all are equal, the least doc_id of the stretch decides.  Of the others a bucket sorts the
   suffixes of shards of distinct stretches and keeps their Burrows-Wheeler transforms.
   The shards are merged by refining their interleave: from the order by the first 8 bytes, each
   round puts two preceding bytes in front (a stable counting sort of the transform), until the
   order holds for ``width`` bytes.  No suffix is compared again; where a round separates
   neighbours, their common prefix ends, and what is never separated is a repeated interval.  The
   least doc_id of each interval decides which windows go.
5. Each chunk removes the union of its windows.

Texts are shuffled once; all else is packed arrays.  A bucket's size is bounded by the number of
buckets, which follows the bytes of the input; a string with very many copies arrives once from
each chunk.

Defined results: null text counts as empty; rows without doc_id lose nothing and take nothing from
others; rows with the same doc_id take nothing from each other; repeated rows give repeated rows;
what is kept is bytes, since a cut may fall inside a character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer

WIDTH = 50
#: Length of the hashed strings whose least hash in a window is the window's anchor.
ANCHOR = 20
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
SHARD_BYTES = 512 << 10
#: Ends a stretch; no UTF-8 text holds it.
END = 0xFF
NO_DOC = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(max(n, 1), b, np.uint64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return out[0], out[1]


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows under one anchor: (row, first window, windows, anchor), and their text hashes.

    Works through runs of rows of about a megabyte, so that its arrays stay small.
    """
    values = _byte_values()
    parts: list[tuple[np.ndarray, ...]] = []
    power, unpower = _powers(1 << 20)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        x = data[offsets[at] : offsets[end]]
        if len(x) >= width:
            if len(x) + 1 > len(power):
                power, unpower = _powers(len(x) + 1)
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(values[x] * power[: len(x)], out=total[1:])
            h = (total[ANCHOR:] - total[:-ANCHOR]) * unpower[: len(x) - ANCHOR + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            k, w = 1, width - ANCHOR + 1
            while 2 * k <= w:
                h = np.minimum(h[:-k], h[k:])
                k *= 2
            if k < w:
                h = np.minimum(h[: -(w - k)], h[w - k :])
            edge = offsets[at : end + 1] - offsets[at]
            row = np.repeat(np.arange(end - at), np.diff(edge))[: len(h)]
            last = edge[1:][row] - width
            place = np.arange(len(h))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first &= place <= last
            i = np.flatnonzero(first)
            stop = np.minimum(np.append(i[1:], len(h)), last[i] + 1)
            digest = (total[stop + width - 1] - total[i]) * unpower[i]
            parts.append((row[i] + at, i - edge[row[i]], stop - i, h[i], digest ^ (stop - i).astype(np.uint64)))
        at = end
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not depend on how they came."""
    return table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffer(table.column("text"))
    ids = table.column("doc_id").to_pandas()
    return data, offsets, ids.fillna(-1).to_numpy(np.int64) if not ids.isna().any() else np.array([NO_DOC if pd.isna(i) else int(i) for i in ids], np.int64)


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order by bucket, the buckets met, the edges between them."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    return order, names, np.append(first, len(order))


def shard_order(text: np.ndarray, width: int) -> np.ndarray:
    """The suffixes of one shard (read as a ring) by their first ``width`` bytes or more."""
    n = len(text)
    ring = np.concatenate((text, np.resize(text, 8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | ring[i : i + n].astype(np.uint64)
    depth = 8
    order = np.argsort(key, kind="stable")
    while True:
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if depth >= width or rank[order[-1]] == n - 1:
            return order
        key = rank * np.int64(n + 1) + np.roll(rank, -(depth % n))
        order = np.argsort(key, kind="stable")
        depth *= 2


def merged_intervals(shards: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards (byte strings that end in END): (suffixes in order, number of the interval of each).

    Suffixes are numbered through all shards; those with equal first ``width`` bytes share a number.
    ``width`` - 8 must be even.
    """
    orders, keys, before, back = [], [], [], []
    base = 0
    for text in shards:
        n = len(text)
        order = shard_order(text, width)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        ring = np.concatenate((text, np.resize(text, 8)))
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | ring[i : i + n].astype(np.uint64)
        # The transform, two bytes deep, and the rows that it leads back to.
        one, two = np.roll(text, 1), np.roll(text, 2 % n if n > 1 else 0)
        before.append(((two.astype(np.uint16) << np.uint16(8)) | one)[order])
        back.append(place[(order - 2) % n] + np.int32(base))
        keys.append(key[order])
        orders.append(order + base)
        base += n
    key = np.concatenate(keys)
    rows = np.argsort(key, kind="stable")  # the first interleave: sorted runs are merged
    step = np.zeros(base, bool)
    step[1:] = key[rows[1:]] != key[rows[:-1]]
    group = np.cumsum(step, dtype=np.int32)
    del key, keys
    transform, back_to = np.concatenate(before), np.concatenate(back)
    rows = rows.astype(np.int32)
    for _ in range((width - 8) // 2):
        symbol = transform[rows]
        sort = np.argsort(symbol, kind="stable")
        symbol, group, rows = symbol[sort], group[sort], back_to[rows[sort]]
        step[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(step, dtype=np.int32)
    return np.concatenate(orders)[rows], group


def _range_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of ``docs`` (doc_id, text)."""
    if width < 2 * ANCHOR or width % 2:
        raise ValueError(f"width must be even and at least {2 * ANCHOR}")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, n_buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    def place(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (anchor % np.uint64(n_buckets)).astype(np.int32), (anchor // np.uint64(n_buckets)).astype(np.uint32)

    def name_anchors(key: tuple, table: pa.Table) -> pa.Table:
        table = _ordered(table)
        data, offsets, _ = _texts(table)
        row, _, _, anchor, digest = windows(data, offsets, width)
        order = np.lexsort((digest, anchor))
        anchor, row, digest = anchor[order], row[order], digest[order]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        i = np.flatnonzero(new)
        many = np.maximum.reduceat(row, i) != np.minimum.reduceat(row, i) if len(i) else np.zeros(0, bool)
        many = np.repeat(many, np.diff(np.append(i, len(row))))
        new[1:] |= digest[1:] != digest[:-1]
        i = np.flatnonzero(new)
        bucket, low = place(anchor[i])
        sort, names, edge = _split(bucket)
        low, many, digest = low[sort], many[i][sort], digest[i][sort]
        pieces = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        return pa.table(
            {
                "bucket": pa.array(names, pa.int32()),
                "chunk": pa.array(np.full(len(names), key[0].as_py()), pa.int32()),
                "anchors": pa.array([low[a:b].tobytes() for a, b in pieces], pa.binary()),
                "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in pieces], pa.binary()),
                "digests": pa.array([(digest[a:b] >> np.uint64(32)).astype(np.uint32).tobytes() + ((digest[a:b] >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for a, b in pieces], pa.binary()),
            }
        )

    def report_repeated(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        anchors = [np.frombuffer(b, np.uint32) for b in pdf["anchors"]]
        every = np.concatenate(anchors)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(a)) for m, a in zip(pdf["many"], anchors)]).astype(bool)
        digest = np.concatenate([(np.frombuffer(d, np.uint32, len(a)).astype(np.uint64) << np.uint64(16)) | np.frombuffer(d, np.uint16, len(a), 4 * len(a)) for d, a in zip(pdf["digests"], anchors)])
        order = np.argsort(every, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        i = np.flatnonzero(new)
        times = np.diff(np.append(i, len(order)))
        repeated = np.empty(len(order), bool)
        repeated[order] = np.repeat((times > 1) | np.maximum.reduceat(many[order], i), times)
        differ = np.empty(len(order), bool)
        differ[order] = np.repeat(np.maximum.reduceat(digest[order], i) != np.minimum.reduceat(digest[order], i), times)
        cuts = np.cumsum([len(a) for a in anchors])[:-1]
        kept = list(zip(anchors, np.split(repeated, cuts), np.split(differ, cuts)))
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "anchors": [a[k].tobytes() for a, k, _ in kept], "differ": [d[k].tobytes() for _, k, d in kept]})

    def send_stretches(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _ordered(table)
        data, offsets, ids = _texts(table)
        row, start, count, anchor, digest = windows(data, offsets, width)
        bucket, low = place(anchor)
        blobs = replies.column("anchors").to_pylist()
        wanted = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint32).astype(np.uint64) + (np.uint64(k) << np.uint64(32)) for k, b in zip(replies.column("bucket").to_pylist(), blobs))])
        differ = np.concatenate([np.zeros(0, bool), *(np.frombuffer(b, bool) for b in replies.column("differ").to_pylist())])
        order = np.argsort(wanted, kind="stable")
        wanted, differ = wanted[order], differ[order]
        full = (bucket.astype(np.uint64) << np.uint64(32)) + low
        at = np.minimum(np.searchsorted(wanted, full), max(0, len(wanted) - 1))
        keep = np.flatnonzero(wanted[at] == full) if len(wanted) else np.zeros(0, np.int64)
        differ = differ[at[keep]] if len(wanted) else differ
        sort = np.lexsort((digest[keep], bucket[keep]))
        keep, differ = keep[sort], differ[sort]
        row, start, count, bucket, digest = row[keep], start[keep], count[keep], bucket[keep], digest[keep]
        first = np.ones(len(keep), bool)
        first[1:] = (digest[1:] != digest[:-1]) | (bucket[1:] != bucket[:-1])
        head = np.flatnonzero(first)
        times = np.diff(np.append(head, len(keep)))
        out: dict[str, list] = {k: [] for k in ("bucket", "digest", "differ", "text", "count", "times", "doc", "row", "start")}
        names, at = np.unique(bucket[head], return_index=True)
        edge = np.append(at, len(head))
        for name, a, b in zip(names.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            h = head[a:b]
            d = h[differ[h]]
            sizes = count[d] + width  # with END
            text = data[np.minimum(_range_index(offsets[row[d]] + start[d], sizes), len(data) - 1)]
            text[np.cumsum(sizes) - 1] = END
            o = slice(h[0], len(keep) if b == len(head) else head[b])
            values = (name, digest[h], differ[h], text, count[h].astype(np.int32), times[a:b].astype(np.int32), ids[row[o]], row[o].astype(np.int32), start[o].astype(np.int32))
            for k, v in zip(out, values):
                out[k].append(v if k == "bucket" else v.tobytes())
        n = len(out["bucket"])
        types = {"bucket": pa.int32()} | {k: pa.binary() for k in list(out)[1:]}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()} | {"chunk": pa.array([key[0].as_py()] * n, pa.int32())})

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable")
        column = lambda k, t: np.concatenate([np.frombuffer(b, t) for b in pdf[k]])
        digest, differ, count, times = column("digest", np.uint64), column("differ", bool), column("count", np.int32).astype(np.int64), column("times", np.int32)
        doc, row, start = column("doc", np.int64), column("row", np.int32), column("start", np.int32)
        chunk = np.repeat(pdf["chunk"].to_numpy(), [len(b) // 8 for b in pdf["doc"]])
        text = column("text", np.uint8)
        # Equal stretches of several chunks are one; the least document of each.
        _, head, same = np.unique(digest, return_index=True, return_inverse=True)
        least = np.full(len(head), NO_DOC)
        np.minimum.at(least, same, np.minimum.reduceat(doc, np.cumsum(times) - times))
        odd = np.flatnonzero(differ[head])  # the distinct stretches whose windows must be compared
        sizes = np.where(differ, count + width, 0)
        begin = np.cumsum(sizes) - sizes
        odd = odd[np.argsort(head[odd], kind="stable")]  # in the order of chunks
        n = count[head[odd]]
        spelt = text[_range_index(begin[head[odd]], n + width)]
        base = np.cumsum(n + width) - (n + width)
        owner = np.full(len(spelt), NO_DOC)
        owner[_range_index(base, n)] = np.repeat(least[odd], n)
        if len(spelt):
            ends = np.append(base[1:], len(spelt))
            cuts = np.unique(np.searchsorted(ends, np.arange(SHARD_BYTES, len(spelt), SHARD_BYTES)))
            shards = np.split(spelt, ends[cuts[ends[cuts] < len(spelt)]])
            order, group = merged_intervals(shards, width)
            lowest = np.minimum.reduceat(owner[order], np.flatnonzero(np.diff(group, prepend=-1)))
            owner[order] = lowest[group]
        # The windows of every occurrence that a smaller document has, as runs.
        where_odd = np.full(len(head), -1)
        where_odd[odd] = base
        stretch = np.repeat(same, times)
        runs = np.repeat(count, times)
        mine = np.where(doc == NO_DOC, -NO_DOC, doc)
        whole = np.flatnonzero((where_odd[stretch] < 0) & (least[stretch] < mine))
        part = np.flatnonzero(where_odd[stretch] >= 0)
        gone = owner[_range_index(where_odd[stretch[part]], runs[part])] < np.repeat(mine[part], runs[part])
        where = np.repeat(np.arange(len(part)), runs[part])
        edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
        new = np.zeros(len(gone), bool)
        new[1:] = where[1:] != where[:-1]
        opens = np.flatnonzero((edges[:-1] == 1) | (new & gone))
        closes = np.flatnonzero((edges[1:] == -1) | (np.append(new[1:], True)[: len(gone)] & gone)) + 1
        o = part[where[opens]]
        offset = (np.cumsum(runs[part]) - runs[part])[where[opens]]
        a = np.concatenate((start[whole], start[o] + opens - offset))
        b = np.concatenate((start[whole] + runs[whole] + width - 1, start[o] + closes - offset + width - 1))
        o = np.concatenate((whole, o))
        sort, names, edge = _split(chunk[o])
        r, a, b = row[o][sort].astype(np.int32), a[sort].astype(np.int32), b[sort].astype(np.int32)
        pieces = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        return pd.DataFrame({"chunk": names.astype(np.int32), "row": [r[i:j].tobytes() for i, j in pieces], "a": [a[i:j].tobytes() for i, j in pieces], "b": [b[i:j].tobytes() for i, j in pieces]})

    def apply(key: tuple, table: pa.Table, spans: pa.Table) -> pa.Table:
        table = _ordered(table)
        data, offsets, _ = _texts(table)
        mark = np.zeros(len(data) + 1, np.int32)
        joined = [np.concatenate([np.frombuffer(b, np.int32) for b in spans.column(k).to_pylist()] or [np.zeros(0, np.int32)]) for k in ("row", "a", "b")]
        base = offsets[joined[0]]
        np.add.at(mark, base + joined[1], 1)
        np.add.at(mark, base + joined[2], -1)
        gone = np.cumsum(mark[:-1]) > 0
        kept, n_removed, n_spans = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            g = gone[a:b]
            kept.append(data[a:b][~g].tobytes())
            n_removed.append(int(g.sum()))
            n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0]))
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    named = dealt.groupBy("chunk").applyInArrow(name_anchors, "bucket int, chunk int, anchors binary, many binary, digests binary")
    replies = named.groupBy("bucket").applyInPandas(report_repeated, "chunk int, bucket int, anchors binary, differ binary")
    sent = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send_stretches, "bucket int, digest binary, differ binary, text binary, count binary, times binary, doc binary, row binary, start binary, chunk int")
    spans = sent.groupBy("bucket").applyInPandas(judge, "chunk int, row binary, a binary, b binary")
    return dealt.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
