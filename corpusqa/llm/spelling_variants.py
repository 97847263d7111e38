"""Spelling variant grouping: PartEnum signatures of letter multisets.

A word's letters, the first, second ... of each kind apart, are a binary vector; words one edit apart
have vectors of Hamming distance two at most.  The places of all vectors are dealt out to four parts, and
each of the six choices of two parts gives a signature of what the vector has there: vectors that differ in
two places at most differ in two parts at most, so they have a signature in common.  As one edit also
leaves the first or the last half of a word whole, a signature goes with either half, and with the
shorter word's length: words meet by equality of all that, and the words of equal keys are verified.

Words are counted by task in Arrow batches, whole texts piece by piece, and summed up by Spark; the
damage of a word depends on its document only, so that each word of a piece is damaged once.

Spark sizes a table by its compressed file, and keys by the words that they are made of, far below what the rows
take in memory; so all joins are named as merge joins, and no table goes whole to the driver and each executor.

Defined results: a null or empty text has no words; a null doc_id counts as empty in the hash that
damages; words whose damage leaves fewer than ``least`` code points don't count; equal texts of several
rows all count; without near words a word has n_near 0, no form, and is its own root; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Every so many words' damage, by crc32.
DAMAGED = 97
#: Parts of the places; two are left out of a signature.
PARTS = 4
KEPT = [(a, b) for a in range(PARTS) for b in range(a)]
#: Code points of a text that are matched at a time, and distinct words that a task gathers before it hands them on.
PIECE, GATHERED = 1 << 20, 1 << 18
#: Words whose keys are made at a time.
WORDS = 1 << 13
_BASE = 0x9E3779B97F4A7C15


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that no run of letters crosses (a longer run is whole)."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (run := RUN.match(text, end)):
            end = run.end()
        yield text[at:end]
        at = end


def damaged(run: str, key: int) -> str:
    """The lower-cased run without one code point, if its hash (from ``key``, that of what precedes it) says so."""
    h = zlib.crc32(run.encode(), key)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = 5, occurrences: int = 3) -> DataFrame:
    """(word, n) of all damaged words of at least ``least`` code points and so many occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                key = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for piece in pieces(text.as_py() or ""):
                    for word, n in Counter(RUN.findall(piece.encode().lower().decode())).items():
                        word = damaged(word, key)
                        if len(word) >= least:
                            seen[word] += n
                    if len(seen) >= GATHERED:
                        yield hand_on()
        if seen:
            yield hand_on()

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the word, key, whether it is the longer one) of all keys of non-empty words.

    Key of a word as one of a length m: a signature, m, and the first m // 2 or the last m - m // 2
    code points.  A word takes part with its own length, and as the longer one with its length less one.
    """
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes)) - starts[row]
    # The first, second ... of each letter of a word.
    order = np.lexsort((codes, row))
    new = np.ones(len(order), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    turn = np.empty(len(order), np.uint64)
    turn[order] = (np.arange(len(order)) - begin).astype(np.uint64)
    place = mix(codes * np.uint64(_BASE) + turn)
    part = place >> np.uint64(62)
    value = mix(place + np.uint64(1))
    sums = np.stack([np.add.reduceat(np.where(part == p, value, np.uint64(0)), starts) for p in range(PARTS)])
    letter = mix(codes + np.uint64(7))
    power = np.multiply.accumulate(np.full(int(lengths.max()) + 1, _BASE | 1, np.uint64))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    every = np.arange(len(words))
    for longer in (False, True):
        m = lengths - longer
        half = m // 2
        head = np.add.reduceat(np.where(at < half[row], letter * power[at], np.uint64(0)), starts)
        back = lengths[row] - 1 - at
        tail = np.add.reduceat(np.where(back < (m - half)[row], letter * power[back], np.uint64(0)), starts)
        for side, text in enumerate((head, tail)):
            which = mix(text + mix(m.astype(np.uint64) * np.uint64(2) + np.uint64(side + _BASE // 3)))
            for i, (a, b) in enumerate(KEPT):
                key = mix(which ^ mix(mix(sums[a] + np.uint64(i)) + sums[b]))
                out.append((every, key.view(np.int64), np.full(len(words), longer)))
    return tuple(np.concatenate(x) for x in zip(*out))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of ``words`` (word, n) that are one insertion, deletion or replacement apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, WORDS):
                part = batch.slice(first, WORDS)
                at, key, longer = keys(part.column(0).to_pylist())
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(longer), part.column(0).take(at), part.column(1).take(at)], names=["key", "longer", "word", "n"])

    keyed = words.select("word", "n").where("word <> ''").mapInArrow(run, "key long, longer boolean, word string, n long")
    a = keyed.where("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Each pair in one order, whatever keys may be equal by chance.
    ordered = F.when(F.col("longer"), F.length("b") == F.length("a") + 1).otherwise((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    met = a.join(b.hint("merge"), "key").where(ordered & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(both.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last that forms lead to.  Each round doubles how far they have been followed."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = cut(links.join(beyond.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word (of equals the least), if it has ``times`` the occurrences."""
    words = cut(words)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = cut(words.join(near.hint("merge"), "word", "left"))
    stands = -F.col("best.m") >= times * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("best.other")).alias("form"), F.when(stands, -F.col("best.m")).alias("form_n"))
    out = formed.join(roots(formed.where("form IS NOT NULL")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
