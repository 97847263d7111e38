"""Repeated windows of characters, and pattern hits by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.cadence import name_forms
from corpusqa.operators.phrases import contained
from corpusqa.schemas import CJK, LangPack

KEY = ["corpus", "seq"]


class WindowHasher:
    """Hashes of all windows of a text, from prefix sums of a polynomial in a ring modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            steps = (np.full(n + n // 4, b, np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
            self.power, self.inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), x))) for x in steps)

    def __call__(self, text: str, width: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        self._grow(len(codes))
        codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        codes ^= codes >> np.uint64(32)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.power[: len(codes)], out=total[1:])
        return (total[width:] - total[:n]) * self.inverse[:n]


def repeated_windows(text: str, width: int, hasher: WindowHasher) -> Iterator[tuple[str, int, int]]:
    """(window, places, distance of the first and last) of each window that a text has twice or more; equal hashes are compared by text."""
    h = hasher(text, width)
    order = np.argsort(h, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
        places: dict[str, list[int]] = {}
        for i in order[a:b].tolist():
            window = text[i : i + width]
            seen = places.setdefault(window, [0, i, i])
            seen[0], seen[2] = seen[0] + 1, i
        yield from ((window, n, last - first) for window, (n, first, last) in places.items() if n > 1)


def section_repeats(sections: DataFrame, width: int = 12, skip: str | None = None, strip: str | None = None, apart: bool = False) -> DataFrame:
    """(corpus, seq, gram, n) of windows that a section has twice or more.

    A section's windows are hashed and sorted where it lies; only the repeated ones leave its row, once
    each.  ``strip`` deletes characters beforehand; ``skip`` leaves windows out that match; ``apart`` asks for two
    places that don't overlap.
    """
    s = sections.select(*KEY, (F.regexp_replace("text", strip, "") if strip else F.col("text")).alias("text")).where(F.length("text") > width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(2)):
                for x in repeated_windows(text.as_py(), width, hasher):
                    at.append(i)
                    found.append(x)
            place = pa.array(at, pa.int64())
            grams, n, reach = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(grams, pa.string()), pa.array(n, pa.int64()), pa.array(reach, pa.int64())], names=[*KEY, "gram", "n", "reach"])

    kinds = ", ".join(f"{k} {sections.schema[k].dataType.simpleString()}" for k in KEY)
    out = s.mapInArrow(run, f"{kinds}, gram string, n long, reach long")
    if skip:
        out = out.where(~F.col("gram").rlike(skip))
    return (out.where(F.col("reach") >= width) if apart else out).drop("reach")


def neighbour_repeats(sections: DataFrame, width: int = 12, distance: int = 1) -> DataFrame:
    """(corpus, seq, shared): distinct windows that a section shares with the one ``distance`` later.

    The two texts meet by their numbers, and their windows' hashes are compared there; equal ones by text.
    """
    first = sections.select(*KEY, "text").where(F.length("text") >= width)
    later = first.select("corpus", (F.col("seq") - distance).alias("seq"), F.col("text").alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher()
        for batch in batches:
            shared = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.as_py(), b.as_py()
                (x, i), (y, j) = (np.unique(hasher(t, width), return_index=True) for t in (a, b))
                _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                shared.append(sum(a[p : p + width] == b[q : q + width] for p, q in zip(i[at].tolist(), j[to].tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], names=[*KEY, "shared"])

    kinds = ", ".join(f"{k} {sections.schema[k].dataType.simpleString()}" for k in KEY)
    return first.join(later, KEY).select(*KEY, "text", "later").mapInArrow(run, f"{kinds}, shared long").where("shared > 0")


def speech_hits(sections: DataFrame, roster: DataFrame, pack: LangPack = CJK, near: int = 12, lead: int = 4) -> DataFrame:
    """(corpus, seq, name, n): a name, or an alias of it, and a verb of saying close before an opening quote, or close behind a closing one.

    A name right behind a word of address is spoken to and doesn't speak.  Only sections that have a form
    are searched with its pattern; ``roster`` is (name) or (name, aliases).
    """
    opener, closer = pack.openers[0], pack.closers[0]
    forms = name_forms(roster).select("name", "form")
    who = F.concat(F.lit(f"(?<![{pack.address}])\\Q"), F.replace("form", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?:{pack.say})"))
    spoken = F.concat(who, F.lit(f"(?=[^{pack.stops}\\n]{{0,{lead}}}[{opener}])|[{closer}][^{pack.stops}\\n]{{0,{near}}}"), who)
    there = contained(sections, KEY, forms).join(sections.select(*KEY, "text"), KEY)
    hits = there.select(*KEY, "form", F.regexp_count("text", spoken).cast("bigint").alias("n"))
    return hits.where("n > 0").join(forms, "form").groupBy(*KEY, "name").agg(F.sum("n").alias("n"))
