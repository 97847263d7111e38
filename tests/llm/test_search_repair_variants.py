"""Top-k search, conversation repair and spelling variants against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusqa.llm import conversation_repair, queries, spelling_variants, topk_search

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, row STRING, id STRING, weights INT"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", 3) for i, v in rows], VECTORS)


def brute_search(rows, k):
    """{query place: [(score, id)]}; equal rows can't be told apart."""
    fit = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(fit):
        if q is not None and q % 20 == 0:
            found = [(sum(x * y for x, y in zip(a, b)), c) for place, (c, b) in enumerate(fit) if place != at]
            found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out.append((q, [(i + 1, c, s) for i, (s, c) in enumerate(found[:k])]))
    return sorted(out, key=str)


def found_search(out):
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r.query_row, r.query_id].append((r["rank"], r.id, r.score))
    return sorted(((q, sorted(x)) for (_, q), x in by.items()), key=str)


@pytest.mark.parametrize("size", [30, 1500])
def test_search(spark, size, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAST_ROWS", 200)
    monkeypatch.setattr(topk_search, "CHUNK", 64)
    rng = random.Random(size)
    rows = [(i, [round(rng.gauss(0, 0.2), 2) if rng.random() < 0.7 or d < 3 else 0.0 for d in range(12)]) for i in range(size)]
    rows += [(20, rows[0][1])] * 3 + [(None, rows[1][1]), (40, []), (60, rows[2][1][:5]), (7, rows[3][1] * 2)]  # repeated rows, a null id, an empty, a short and a long vector
    rows += [(80, None), (81, [0.1, None]), (100, [float("nan")] * 12), (101, [float("inf")] * 12)]
    rng.shuffle(rows)
    out = topk_search.search(topk_search.integer_vectors(vectors(spark, rows)), F.col("id") % 20 == 0, 20)
    assert found_search(out) == brute_search(rows, 20)


def test_search_of_large_weights_and_nothing(spark):
    rows = [(0, [3e7, -1.0]), (1, [2e7, 5.0]), (2, [-3e7, 1e9]), (20, [1e-3, 0.0])]
    assert found_search(topk_search.search(topk_search.integer_vectors(vectors(spark, rows)), F.col("id") % 20 == 0, 2)) == brute_search(rows, 2)
    assert topk_search.search(topk_search.integer_vectors(vectors(spark, rows[:0])), F.col("id") % 20 == 0).collect() == []
    assert topk_search.search(topk_search.integer_vectors(vectors(spark, [(0, [1.0])])), F.col("id") % 20 == 0).collect() == []


def test_search_against_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.op11_topk_search(spark, sf_dir).collect())
    assert got == sorted(c.execute(queries.TOPK_SQL).fetchall())


FOLLOWS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
SPACES = " \t\n\x0b\x0c\r"
TALK = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, kind STRING, digest STRING"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(SPACES)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "ok" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def whole_program(rows):
    """The program with whole audits and texts for each state."""
    told = faults(rows)

    def closed(found):
        again = True
        while again:
            again = False
            for q in list(found):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = FOLLOWS.get((initial, q))
                    new = (found[q][0] + 2, found[q][1] + "I", (*found[q][2], role + ":"))
                    if to is not None and (to not in found or new[:2] < found[to][:2]):
                        found[to], again = new, True
        return found

    now = closed({0: (0, "", ())})
    for (_, _, role, text), fault in zip(rows, told):
        found = {}
        for q, (cost, audit, said) in now.items():
            ways = [(q, cost + 3, "D", ())]
            if fault in ("ok", "truncated"):
                more = cost + (fault == "truncated")
                ways += [(FOLLOWS[role[:1], q], more, "K", (f"{role}:{text}",))] if (role[:1], q) in FOLLOWS else []
                ways += [(FOLLOWS[i, q], more + 2, "R", (f"{given}:{text}",)) for i, given in (("u", "user"), ("a", "assistant")) if (i, q) in FOLLOWS]
            for to, c, letter, new in ways:
                if to not in found or (c, audit + letter) < found[to][:2]:
                    found[to] = (c, audit + letter, said + new)
        now = closed(found)
    cost, audit, said = min(now[q] for q in (0, 3) if q in now)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(told.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def all_edits(kinds):
    """(cost, audit) of the best of all edits, with up to three inserts at each place."""
    best, pattern = None, re.compile("(s?(ua)+)?")
    inserts = ["".join(p) for k in range(4) for p in itertools.product("ua", repeat=k)]

    def walk(i, cost, audit, initials):
        nonlocal best
        if best and cost > best[0]:
            return
        for put in inserts:
            c, a, now = cost + 2 * len(put), audit + "I" * len(put), initials + put
            if i == len(kinds):
                if pattern.fullmatch(now) and (best is None or (c, a) < best):
                    best = (c, a)
                continue
            initial, fault = kinds[i]
            walk(i + 1, c + 3, a + "D", now)
            if fault != "duplicate":
                more = c + (fault == "truncated")
                if initial != "t":
                    walk(i + 1, more, a + "K", now + initial)
                walk(i + 1, more + 2, a + "R", now + "u")
                walk(i + 1, more + 2, a + "R", now + "a")

    walk(0, 0, "", "")
    return best


def repaired(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TALK)
    return {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damage(frame), **options).collect()}


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))):
        by[r[0]].append(r)
    return {conv: whole_program(rs) for conv, rs in by.items()}


def test_repair_of_all_edits():
    """The program's steps, alone, against all ways to edit up to four rows."""
    rng, steps = random.Random(2), conversation_repair.Steps()
    role = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    for _ in range(400):
        kinds = [(rng.choice("suat"), rng.choice(("ok", "ok", "truncated", "duplicate"))) for _ in range(rng.randint(0, 4))]
        talk = conversation_repair.Conversation("x", steps, 2)
        for initial, fault in kinds:
            talk.marked = fault != "duplicate"
            talk.row("1", role[initial], "t", False, fault != "truncated")
        assert talk.result()[6:8] == all_edits(kinds)
    assert len(steps.steps) < 1000


def test_repair(spark):
    rng = random.Random(4)
    rows = {}
    for conv in range(150):
        for turn in range(rng.randint(1, 10)):
            turn = turn + 40 if rng.random() < 0.1 else turn
            text = rng.choice(["ok.", "no stop", "", " \t", "é!", "x. \n", None] + [f"{conv} {turn}."] * 8)
            rows[conv, turn] = (conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text)
    rows = list(rows.values()) + [(500, None, "user", "a."), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (501, 10**17, "user", "a."), (501, 10**17 + 2, "assistant", "b.")]
    rng.shuffle(rows)
    assert repaired(spark, rows) == expected(rows)
    assert repaired(spark, rows[:0]) == {}


def test_repair_of_a_giant(spark):
    """One conversation over many Arrow batches, its steps in a file; a repeated row is a duplicate."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["yes.", f"{t}.", f"{t}"])) for t in range(4000)] + [(2, 5, "user", "a.")]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert repaired(spark, rows, held=64) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    twice = repaired(spark, [(7, 3, "user", "a."), (7, 3, "user", "a.")])
    assert twice == expected([(7, 3, "user", "a."), (7, 3, "user", "a.")])


def test_repair_of_dropped_conversations(spark):
    gone = next(c for c in range(10000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 1, "user", "a.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf_dir).collect()} == expected(rows)


def brute_words(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_variants(words):
    near, wild = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in wild.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w, n in words.items():
        most, best = min(((-words[x], x) for x in near[w]), default=(0, None))
        form[w] = best if best and -most >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_variants_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.word: tuple(r) for r in queries.op13_spelling_variants(spark, sf_dir).collect()} == brute_variants(brute_words(rows))


def test_variants_of_dense_words(spark):
    """Few letters and short words: many near ones, runs of one letter, long chains of forms."""
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(900)}
    words |= {"a" * i: 3 * 2**i for i in range(1, 25)}  # a chain to follow
    frame = spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")
    assert {r.word: tuple(r) for r in spelling_variants.group_variants(frame).collect()} == brute_variants(words)


def test_variants_broadcast_nothing(spark, monkeypatch):
    """A file of words is small, and its keys take some two hundred times as much in memory: no join may go by the file's size."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    cut = spelling_variants.cut
    monkeypatch.setattr(spelling_variants, "cut", lambda df: cut(seen(df)))
    frame = cut(spark.createDataFrame([("hello", 9), ("hallo", 3), ("halloo", 1)], "word STRING, n BIGINT"))
    out = spelling_variants.group_variants(frame)
    assert {r.word: r.root for r in seen(out).collect()} == {"hello": "hello", "hallo": "hello", "halloo": "hello"}
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not [p for p in plans if "Broadcast" in p]


def test_words_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "PIECE", 50)
    monkeypatch.setattr(spelling_variants, "GATHERED", 20)
    rng = random.Random(8)
    texts = [None, "", "123 !?", "Straße ÀÉÎ×÷ŒŠ naïve", "x" * 300, " ".join(rng.choice(["Hello", "hellö", "WORLD's", "abcde", "日本語abcdef"]) for _ in range(500))]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "hello hello hello"), (5, texts[5])]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id BIGINT, text STRING, word STRING")
    assert {r.word: r.n for r in spelling_variants.count_words(frame).collect()} == brute_words(rows)
    assert spelling_variants.group_variants(spelling_variants.count_words(frame.limit(0))).collect() == []
