"""Secret scans with DataFrame functions only.

Three base rules find assignments, access keys and hexadecimal strings.  Beyond them two character
Markov models (bigrams), one of random strings and one of ordinary identifiers, are compared by
their log-likelihood ratio on every long token that no base span touches.  Both are trained on the
corpus: what the base rules capture is labelled random, all other tokens ordinary, in a bounded
sample of documents.

Offsets are code points, ends exclusive.  Defined results: null text counts as empty and has no
spans; repeated rows give repeated rows; columns of the input are kept unless they bear the name of
a result column; without any training token both models are uniform and no span is added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Kinds in their order at one place.
KINDS = ("assign", "access", "hex", "markov")
#: For each base kind: the pattern with its value as group, the least length of the value.
RULES = {
    "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8),
    "access": (r"(AKIA[A-Z0-9]{12,})", 16),
    "hex": (r"([0-9a-f]{32,})", 32),
}
#: What a text must match for a base kind to be looked for.
HINTS = {"assign": "(?i)(?:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{32}"}
TOKEN = "[A-Za-z0-9+/_.=-]"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Documents (in the order of a hash of doc_id) whose tokens train the two models.
SAMPLE_DOCUMENTS = 4000
#: Length of the tokens that the models judge, and the ratio (natural log) that makes a span.
LEAST_TOKEN, LEAST_RATIO = 20, math.log(1e4)


SPANS = "array<struct<start: bigint, kind: int, end: bigint, value: string>>"
#: Items that are folded, or searched, at a time: a fold copies its state at each step, so that no state may grow with a text.
BLOCK, SEARCHED = 256, 64


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``value`` taken once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(items: str, size: int, block: str) -> str:
    """SQL of the array of ``block`` (of ``b``, a run of ``size`` items) for all runs of ``items``."""
    return f"transform(sequence(0, int((size({items}) - 1) div {size})), n -> {_let('b', f'slice({items}, n * {size} + 1, {size})', block)})"


def _spans(whole: str, pattern: str, value: int, least: int, kind: int) -> str:
    """SQL of the spans of a pattern in ``whole``, leftmost and not overlapping, whose value (a group) has ``least`` characters.

    The text before each match gives its place; ``\\G`` ties a match to the end of the one before,
    so that no search is begun twice.  Lengths are summed up within blocks, then over blocks.
    """
    tied = f"\\G([\\s\\S]*?)({pattern})".replace("\\", "\\\\").replace("'", "\\'")
    part = [f"regexp_extract_all({whole}, '{tied}', {k})" for k in (1, 2, value + 2)]
    none = "cast(array() AS array<bigint>)"
    sums = "aggregate({0}, named_struct('at', 0L, 'all', {1}), (a, x) -> named_struct('at', a.at + {2}, 'all', concat(a.all, array(a.at + {2}))), a -> a.all)"
    ends = _blocks("found", BLOCK, sums.format("b", none, "length(x.`0`) + length(x.`1`)"))
    before = sums.format("ends", none, "coalesce(try_element_at(x, -1), 0L)")
    end = f"(if(i < {BLOCK}, 0L, element_at(before, int(i div {BLOCK}))) + element_at(element_at(ends, int(i div {BLOCK}) + 1), i % {BLOCK} + 1))"
    made = f"transform(found, (x, i) -> {_let('e', end, f"named_struct('start', e - length(x.`1`), 'kind', {kind}, 'end', e, 'value', x.`2`)")})"
    bound = _let("found", f"arrays_zip({', '.join(part)})", _let("ends", f"if(size(found) = 0, array({none}), {ends})", _let("before", before, made)))
    return f"cast(filter({bound}, f -> length(f.value) >= {least}) AS {SPANS})"


def _base(whole: str) -> str:
    """SQL of the base spans of a text, by start, then kind."""
    parts = [f"if({whole} RLIKE '{HINTS[rule]}', {_spans(whole, RULES[rule][0], 1, RULES[rule][1], i)}, cast(array() AS {SPANS}))" for i, rule in enumerate(KINDS[:3])]
    return f"array_sort(concat({', '.join(parts)}))"


def _free_tokens(whole: str, base: str, least: int) -> str:
    """SQL of the maximal tokens of ``least`` characters or more that no span of ``base`` touches.

    A token is held against the extents of blocks of spans first.
    """
    tokens = f"if({whole} RLIKE '{TOKEN}{{{least}}}', {_spans(whole, f'(?<!{TOKEN})({TOKEN}{{{least},}})', 1, least, 3)}, cast(array() AS {SPANS}))"
    blocks = _blocks("spans_of_base", SEARCHED, "named_struct('start', element_at(b, 1).start, 'end', array_max(b.end), 'spans', b)")
    apart = "t -> NOT exists(blocks, k -> k.start < t.end AND t.start < k.end AND exists(k.spans, s -> s.start < t.end AND t.start < s.end))"
    return _let("spans_of_base", base, f"if(size(spans_of_base) = 0, {tokens}, {_let('blocks', blocks, f'filter({tokens}, {apart})')})")


def _letters(token: str) -> str:
    """SQL of the numbers of a token's characters."""
    return f"transform(split({token}, ''), c -> instr('{LETTERS}', c))"


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``base``: structs (start, kind, end, value) by start, then kind."""
    return docs.withColumn("base", F.expr(_base("coalesce(text, '')")))


def train(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each bigram, from labelled tokens of a sample.

    The sample holds ``sample_documents`` documents at most; what comes to the driver is the table
    of bigram counts, of fixed size.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    sample = base_spans(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    labelled = sample.selectExpr("base", f"{_free_tokens("coalesce(text, '')", 'base', 5)} AS plain").selectExpr("inline(concat(base, plain))")
    letters = labelled.selectExpr("kind < 3 AS random", f"{_letters('value')} AS letters")
    n = len(LETTERS) + 1
    cells = f"explode(transform(letters, (c, i) -> if(i = 0, 0, element_at(letters, i)) * {n} + c))"
    counts = letters.selectExpr("random", f"{cells} AS cell").groupBy("random", "cell").count().collect()
    seen = np.full((2, n, n), 0.5)
    for random, cell, count in counts:
        seen[int(random), cell // n, cell % n] += count
    logs = np.log(seen / seen.sum(2, keepdims=True))
    return (logs[1] - logs[0]).ravel().tolist()


def scan(docs: DataFrame, ratios: list[float], least_token: int = LEAST_TOKEN, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Add ``base`` and ``spans``, arrays of structs (start, kind, end, value); kind counts in ``KINDS``."""
    table = f"cast(split('{','.join(f'{r:.6f}' for r in ratios)}', ',') AS array<double>)"
    held = unused(docs, "ratio_of_bigrams")
    ratio = f"""aggregate({_letters('t.value')}, named_struct('last', 0, 'sum', 0D),
        (a, c) -> named_struct('last', c, 'sum', a.sum + element_at({held}, a.last * {len(LETTERS) + 1} + c + 1)), a -> a.sum)"""
    judged = f"filter({_free_tokens("coalesce(text, '')", 'base', least_token)}, t -> {ratio} >= {least_ratio!r}D)"
    return base_spans(docs).withColumn(held, F.expr(table)).withColumn("spans", F.expr(f"array_sort(concat(base, {judged}))")).drop(held)


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def counted(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = {KINDS.index(kind)})) AS bigint)")
