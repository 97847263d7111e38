"""Line dedup by pairwise alignment.

A line that several documents have leads from each of them to the earliest one that has it, and so
does a run of such lines (blank ones left out): each run whose length is a power of two, the shortest
runs of ``least_chars`` characters that begin or end in a line and all parts of these, and all lines of
a document.  So a shared block has partners that hold its lines in their order, not only one by one,
and the pairs to align grow with the shared lines, however many documents share one.  Each pair is
aligned by patience diff: lines that occur once on both sides, in the longest common order, anchor
blocks that grow to both sides; what lies between anchors is aligned in the same way.  Where no line
is unique, the longest run of lines that both have is the anchor.  An aligned block of ``least_chars`` characters or more is deleted from the later document.

Blank lines anchor nothing and go only inside a block.  Defined results: null text counts as empty
and stays; rows without doc_id keep their text and lend nothing; rows with the same doc_id do not
align with each other; a document all of whose lines go keeps an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, unused

LEAST_CHARS = 24
BLANK = 0
#: Numbers of the states that ``_longest_order`` holds at a time, beside a few for each halving.
HELD_ENDS = 1 << 21
_BASE = 0x9E3779B97F4A7C15


def _longest_rising(values: list[int]) -> list[int]:
    """Places of one longest rising run (not needing to be adjacent)."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _repeated_anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Anchors where no line is unique on both sides: the start of the longest common run, or, if no
    two lines follow each other on both sides, single lines in a longest common order."""
    x, y = (np.array(v, np.int64).astype(np.uint64) for v in (a, b))

    def common(length: int) -> tuple[int, int] | None:
        """The first run of so many lines that both have, its first line not blank."""
        found = []
        for v in (x, y):
            h = np.zeros(max(0, len(v) - length + 1), np.uint64)
            power, unpower = (np.multiply.accumulate(np.array([1] + [base] * len(v), np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(v) * power[:-1])))
            at = np.flatnonzero(v[: len(h)] != BLANK)
            found.append((at, (total[at + length] - total[at]) * unpower[at]))
        (at_a, h_a), (at_b, h_b) = found
        shared = np.isin(h_a, h_b)
        if not shared.any():
            return None
        k = int(shared.argmax())
        i, j = int(at_a[k]), int(at_b[(h_b == h_a[k]).argmax()])
        return (i, j) if a[i : i + length] == b[j : j + length] else None

    low, best, high = 1, None, min(len(a), len(b))
    while low < high:  # a common run's beginning is common
        middle = (low + high + 1) // 2
        found = common(middle)
        low, best, high = (middle, found, high) if found else (low, best, middle - 1)
    if best:
        return [best]
    return _longest_order(a, b)


def _longest_order(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """One longest common order of lines that aren't blank, as places in a and b; all pairs of equal lines count, none is held.

    ``ends[k]`` is the first place in b at which k + 1 lines of what a has had so far can end.  Of it, only some
    states are kept: those between are made again when the way back comes there, half by half.
    """
    where: dict[int, list[int]] = {}
    for j, v in enumerate(b):
        if v != BLANK:
            where.setdefault(v, []).append(j)
    steps = [i for i, v in enumerate(a) if v in where]
    places = {v: np.array(where[v]) for v in {a[i] for i in steps}}

    def after(ends: np.ndarray, i: int) -> np.ndarray:
        js = places[a[i]]
        ks = np.searchsorted(ends, js)
        first = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
        out = np.append(ends, js[first[-1]]) if ks[-1] == len(ends) else ends.copy()
        out[ks[first]] = js[first]
        return out

    out: list[tuple[int, int]] = []
    need = -1  # how many pairs are still to be found; -1: as many as there can be
    todo = [(0, len(steps), np.zeros(0, np.int64))]
    while todo:
        lo, hi, ends = todo.pop()
        if need == 0 or lo == hi:
            continue
        if hi - lo == 1 or (hi - lo) * (len(ends) + hi - lo) <= HELD_ENDS:
            states = [ends]
            for k in range(lo, hi):
                states.append(after(states[-1], steps[k]))
            for k in range(hi - 1, lo - 1, -1):
                later = states.pop()
                need = len(later) if need < 0 else need
                # The last line of a that has the place at which the pairs still to be found end.
                if need and b[j := int(later[need - 1])] == a[steps[k]]:
                    out.append((steps[k], j))
                    need -= 1
            continue
        middle, state = (lo + hi) // 2, ends
        for k in range(lo, middle):
            state = after(state, steps[k])
        todo += [(lo, middle, ends), (middle, hi, state)]
    return out[::-1]


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, length) of two line sequences."""
    blocks: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        n = 0
        while a0 + n < a1 and b0 + n < b1 and a[a0 + n] == b[b0 + n]:
            n += 1
        if n:
            blocks.append((a0, b0, n))
            a0, b0 = a0 + n, b0 + n
        n = 0
        while a1 - n > a0 and b1 - n > b0 and a[a1 - n - 1] == b[b1 - n - 1]:
            n += 1
        if n:
            blocks.append((a1 - n, b1 - n, n))
            a1, b1 = a1 - n, b1 - n
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {v: j for j, v in enumerate(b[b0:b1], b0) if in_b[v] == 1 and v != BLANK}
        once = [(i, place[v]) for i, v in enumerate(a[a0:a1], a0) if v in place and in_a[v] == 1]
        if once:
            anchors = [once[i] for i in _longest_rising([j for _, j in once])]
        else:
            anchors = _repeated_anchors(a[a0:a1], b[b0:b1])
            anchors = [(a0 + i, b0 + j) for i, j in anchors]
        if not anchors:
            continue
        pa_, pb = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if i < pa_:
                continue  # inside the block before
            todo.append((pa_, i, pb, j))
            if i == a1:
                break
            n = 1
            while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                n += 1
            blocks.append((i, j, n))
            pa_, pb = i + n, j + n
    blocks.sort()
    joined: list[tuple[int, int, int]] = []
    for x in blocks:
        if joined and joined[-1][0] + joined[-1][2] == x[0] and joined[-1][1] + joined[-1][2] == x[1]:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + x[2])
        else:
            joined.append(x)
    return joined


def shared_runs(hashes: list[int], sizes: list[int], shared: set[int], least_chars: int) -> np.ndarray:
    """Hashes of the runs of two or more shared lines that lead to partners (see above)."""
    h = np.array(hashes, np.int64)
    full = np.flatnonzero(h != BLANK)
    h, size = h[full].astype(np.uint64), np.array(sizes, np.int64)[full]
    n = len(h)
    total = np.concatenate(([0], np.cumsum(size)))
    alone = np.concatenate(([0], np.cumsum([x not in shared for x in h.astype(np.int64).tolist()])))
    power, unpower = (np.multiply.accumulate(np.array([1] + [base] * n, np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    value = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h) * power[:n])))
    out, length, short = [], 2, True
    while length <= n:
        i = np.arange(n - length + 1)
        e = i + length
        inside = alone[e] == alone[i]
        if not inside.any():
            break
        if short:
            part = np.minimum(total[e - 1] - total[i], total[e] - total[i + 1]) < least_chars
            short = bool(part.any())
        if length & (length - 1) and length != n:
            inside &= part if short else False
        i, e = i[inside], e[inside]
        out.append(mix((value[e] - value[i]) * unpower[i] + np.uint64(length)))
        length = length + 1 if short or length == n else min(n, 1 << length.bit_length())
    found = [*out, mix(value[n:] + np.uint64(n))] if n > 1 and alone[n] == 0 else out
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def _with_first(keys: DataFrame) -> DataFrame:
    """The rows (doc_id, text_hash, h) whose h several have, each with the earliest of them."""
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    holders = keys.groupBy("h").agg(F.count(F.lit(1)).alias("df"), first).where("df > 1")
    return keys.join(holders.select("h", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "h")


def removed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, removed): the line numbers (from 0) to delete, for documents that lose any."""
    lines = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.expr("transform(split(coalesce(text, ''), '\\n'), l -> if(trim(BOTH ' \\t\\r' FROM l) = '', 0L, xxhash64(l)))").alias("hashes"),
        F.expr("transform(split(coalesce(text, ''), '\\n'), l -> length(l))").alias("sizes"),
    ).dropDuplicates(["doc_id", "text_hash"])
    each = lines.select("doc_id", "text_hash", F.explode(F.array_distinct("hashes")).alias("h")).where(F.col("h") != BLANK)
    shared = _with_first(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text_hash, hashes, sizes, known = (c[row].as_py() for c in batch.columns)
                found = shared_runs(hashes, sizes, set(known), least_chars)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([text_hash]), pa.array([found], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "runs"])

    known = shared.groupBy("doc_id", "text_hash").agg(F.collect_list("h").alias("known")).where("size(known) > 1")
    runs = (
        lines.join(known, ["doc_id", "text_hash"])
        .select("doc_id", "text_hash", "hashes", "sizes", "known")
        .mapInArrow(run, "doc_id long, text_hash long, runs array<long>")
        .select("doc_id", "text_hash", F.explode("runs").alias("h"))
    )
    pairs = shared.unionByName(_with_first(runs)).where("first_id < doc_id").select("doc_id", "text_hash", "first_id", "first_hash").distinct()
    mine = pairs.join(lines, ["doc_id", "text_hash"])
    both = mine.join(lines.select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), F.col("hashes").alias("first_hashes")), ["first_id", "first_hash"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, sizes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                total = np.cumsum([0, *sizes])
                gone: list[int] = []
                for i, _, n in patience_blocks(a, b):
                    if total[i + n] - total[i] >= least_chars:
                        gone += range(i, i + n)
                out.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "gone"])

    aligned = both.select("doc_id", "text_hash", "hashes", "first_hashes", "sizes").mapInArrow(align, "doc_id long, text_hash long, gone array<int>")
    return aligned.where("size(gone) > 0").groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows of ``docs`` with their text cut, plus ``n_lines`` and ``removed`` (array of line numbers)."""
    rest = docs.drop("n_lines", "removed")
    gone_id, gone_hash = unused(rest, "gone_id"), unused(rest, "gone_hash")
    gone = removed_lines(docs, least_chars).withColumnRenamed("doc_id", gone_id).withColumnRenamed("text_hash", gone_hash)
    out = rest.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(gone_hash)), "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (l, i) -> NOT array_contains(removed, i)), '\\n')")
    return out.select(
        *(F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "removed")),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("removed", F.expr("cast(array() AS array<int>)")).alias("removed"),
    )
