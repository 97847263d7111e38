"""Snapshots with commits, nested ledgers, rules and lint in one pass."""

import json

import pytest
from pyspark.sql import functions as F

from corpusqa.operators import lint, metrics, rules
from corpusqa.schemas import CJK, FINDINGS
from corpusqa.sources import nested
from corpusqa.sources.snapshots import Conflict, Store

ROWS = "corpus STRING, seq BIGINT"


def held(store):
    return sorted(tuple(r) for r in store.read().select("corpus", "seq").collect())


def test_readers_see_whole_publications(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read() is None
    store.publish(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], ROWS), "one")
    first = [("a", 1), ("a", 2), ("b", 1)]
    assert held(store) == first
    newer = spark.createDataFrame([("a", 9), ("c", 5)], ROWS)
    store.stage(newer, "two")  # the writer ends between the two steps
    assert held(store) == first and held(Store(spark, str(tmp_path / "s"))) == first
    store.publish(newer, "two")
    second = [("a", 9), ("b", 1), ("c", 5)]
    assert held(store) == second
    store.publish(newer, "two")  # a rerun
    assert held(store) == second and [run for _, run in store.commits()] == ["one", "two"]
    store.stage(newer, "lost")
    assert store.sweep() == ["lost"] and held(store) == second  # "one" still holds b
    store.publish(spark.createDataFrame([("b", 7)], ROWS), "three")
    assert sorted(store.sweep()) == ["one"] and held(store) == [("a", 9), ("b", 7), ("c", 5)]
    store.publish(spark.createDataFrame([], ROWS), "none")
    assert held(store) == [("a", 9), ("b", 7), ("c", 5)]


def test_one_of_two_publications_fails(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.publish(spark.createDataFrame([("a", 1)], ROWS), "first")
    one.stage(spark.createDataFrame([("a", 2)], ROWS), "x")
    two.stage(spark.createDataFrame([("b", 2)], ROWS), "y")
    stale = one.commits()
    two.commit("y")
    seen = iter([stale, stale])  # what it saw before the other's commit
    real = Store.commits
    monkeypatch.setattr(one, "commits", lambda: next(seen, None) or real(one))
    with pytest.raises(Conflict):
        one.commit("x")
    assert held(two) == [("a", 1), ("b", 2)]
    one.publish(spark.createDataFrame([("a", 2)], ROWS), "x")
    assert held(two) == [("a", 2), ("b", 2)]


def test_nested_ledgers(spark):
    chains = {"chains": [{"id": "x", "steps": [{"ch": 1, "holder": "h", "anchors": ["p"], "handover": ["w"]}, {"ch": "2"}, {"ch": "zwei", "anchors": "p"}, {"anchors": []}], "terminal": {"ch": 3, "why": "z", "forbid_after": ["f"]}}, {"steps": "none", "terminal": {"ch": "bad"}}]}
    ledgers = spark.createDataFrame([("a", json.dumps(chains)), ("b", "{broken"), ("c", '{"chains": {"no": 1}}'), ("e", None), ("f", "[1]"), ("g", "{}")], "corpus STRING, json STRING")
    expected = spark.createDataFrame([(c,) for c in "abcdefg"], "corpus STRING")
    out = nested.custody(ledgers, expected)
    assert sorted((r.chain, r.ch, r.holder, r.anchors, r.handover) for r in out["steps"].where("ch IS NOT NULL").collect()) == [("x", 1, "h", ["p"], ["w"]), ("x", 2, None, None, [])]
    assert out["steps"].where("ch IS NULL").count() == 2
    assert [tuple(r) for r in out["terminals"].collect()] == [("a", "x", 3, "z", ["f"])]
    found = sorted((r.corpus, r.rule, r.severity, r.subject or "") for r in out["findings"].collect())
    assert found == [
        ("a", "custody_field", "fail", "$.chains[0].steps[2].anchors"), ("a", "custody_field", "fail", "$.chains[0].steps[2].ch"), ("a", "custody_field", "fail", "$.chains[1].steps"), ("a", "custody_field", "fail", "$.chains[1].terminal.ch"),
        ("b", "custody_invalid", "fail", "$"), ("c", "custody_field", "fail", "$.chains"), ("d", "custody_missing", "info", ""), ("e", "custody_invalid", "fail", "$"), ("f", "custody_invalid", "fail", "$"),
    ]
    onsets = spark.createDataFrame([("a", '{"characters": [{"name": "n", "first_appearance": null, "aliases": ["m"]}, {"name": "o", "first_appearance": "7", "first_speech": "x"}]}')], "corpus STRING, json STRING")
    out = nested.onsets(onsets, expected.limit(1))
    assert sorted((r["name"], r.aliases, r.first_appearance, r.first_speech) for r in out["onsets"].collect()) == [("n", ["m"], None, None), ("o", [], 7, None)]
    assert [r.subject for r in out["findings"].collect()] == ["$.characters[1].first_speech"]


def test_life_and_budget_ledgers(spark):
    life = {"book_end_year": "780", "volume_years": [{"vol": 1, "from": 700, "chapters": "1-10"}, {"vol": 2, "from": "x", "to": 720, "chapters": "11 — 20"}, {"vol": 3, "chapters": "x"}], "chapter_year_overrides": {"7": 699, "x": 1},
            "people": [{"name": "p", "birth_year": 690, "landed": [{"chapter": 1, "year": 700}, {"chapter": None, "vol": 2, "kind": "document"}], "planned": None, "landed_range": {"first": 2, "last": 9}}, {"name": "q", "landed": 5}]}
    expected = spark.createDataFrame([("a",), ("b",)], "corpus STRING")
    out = nested.life_windows(spark.createDataFrame([("a", json.dumps(life))], "corpus STRING, json STRING"), expected)
    assert [tuple(r) for r in out["ends"].collect()] == [("a", 780)]
    assert sorted(tuple(r) for r in out["spans"].collect()) == [("a", 1, 1, 10, 700, 700), ("a", 2, 11, 20, None, 720)]
    assert [tuple(r) for r in out["overrides"].collect()] == [("a", 7, 699)]
    assert sorted((r.phase, r.seq or 0, r.year, r.vol, r.carrier) for r in out["landings"].collect()) == [("landed", 0, None, 2, "document"), ("landed", 1, 700, None, "in_person"), ("range", 2, None, None, "in_person"), ("range", 9, None, None, "in_person")]
    assert sorted((r.corpus, r.rule, r.subject or "") for r in out["findings"].collect()) == [("a", "life_field", "$.people[1].landed"), ("a", "life_field", "$.volume_years[1].from"), ("a", "life_field", "$.volume_years[2].chapters"), ("b", "life_missing", "")]
    out = nested.budget(spark.createDataFrame([("a", '{"floor": 10, "exemptRanges": [{"range": [1, 2]}, {"range": [1]}, {"range": "x"}]}')], "corpus STRING, json STRING"), expected)
    assert sorted(tuple(r) for r in out["budget"].collect()) == [("a", 10, 5000, 5000, None), ("b", 4000, 5000, 5000, None)]
    assert [tuple(r) for r in out["exempt"].collect()] == [("a", 1, 2)]
    assert sorted(r.subject or "" for r in out["findings"].collect()) == ["", "$.exemptRanges[1].range", "$.exemptRanges[2].range"]


def test_rules_in_one_pass(spark):
    s = spark.createDataFrame([("b", 1, "“走。”\n短。"), ("b", 2, ""), ("b", 3, None), ("c", 1, "长" * 50 + "“")], "corpus STRING, seq BIGINT, text STRING")
    found = rules.evaluate(metrics.measure(s, ["corpus", "seq"], CJK), rules.section_rules(10, 40))
    assert ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in found.schema) == FINDINGS
    got = sorted((r.corpus, r.seq, r.rule, r.severity, r.n) for r in found.collect())
    assert got == [
        ("b", 1, "fragmented", "info", 2), ("b", 1, "under_floor", "fail", 6), ("b", 2, "no_paragraph", "fail", 0), ("b", 2, "under_floor", "fail", 0), ("b", 3, "no_paragraph", "fail", 0), ("b", 3, "under_floor", "fail", 0),
        ("c", 1, "over_ceiling", "warn", 51), ("c", 1, "unpaired_quotes", "fail", 1),
    ]
    assert sorted(tuple(r) for r in rules.verdict(found).collect()) == [("b", 5, 0, 1, True), ("c", 1, 1, 0, True)]
    assert rules.evaluate(s, []).count() == 0
    with pytest.raises(ValueError):
        rules.evaluate(s, [rules.Rule("x", "fail", "true"), rules.Rule("x", "warn", "true")])


def test_lint_reads_documents_once(spark):
    text = "# 卷\n### 1. 王五 ## x\n- **身份：** a\n- **身份:** b\n### 王五（二）\n- **出身份：** c\n| a | b |\n|---|---|\n| 1 |\n#### 深\n- **身份：** d"
    docs = spark.createDataFrame([("x", text), ("y", None), ("z", "")], "doc STRING, text STRING")
    lines = lint.doc_lines(docs)
    apart = [lint.lint_glued(lines), lint.lint_level_jump(lines), lint.lint_dup_card(lines), lint.lint_dup_field(lines), lint.lint_colon(lines), lint.lint_field_alias(lines, ("身份",)), lint.lint_table_columns(docs)]
    expected = sorted(tuple(r) for df in apart for r in df.collect())
    together = lint.lint_all(docs, ("身份",))
    assert sorted(tuple(r) for r in together.collect()) == expected
    assert {r.check for r in together.collect()} == {"glued_heading", "level_jump", "dup_card", "dup_field", "colon", "field_alias", "table_columns"}
    plan = lint.lint_all(docs, ("身份",))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1


def brute_moves(before, after, least=0.5):
    """Best pair first over all pairs."""
    lines = lambda t: __import__("collections").Counter(x.strip() for x in (t or "").split("\n") if x.strip())

    def like(a, b):
        if (a or "") == (b or ""):
            return 1.0
        x, y = lines(a), lines(b)
        most = max(sum(x.values()), sum(y.values()))
        return sum((x & y).values()) / most if most else 0.0

    fresh, gone = sorted(after.keys() - before.keys()), sorted(before.keys() - after.keys())
    out, pairs = {}, []
    for text in {before[g] or "" for g in gone}:
        a, b = [g for g in gone if (before[g] or "") == text], [f for f in fresh if (after[f] or "") == text]
        out |= {f: ("renamed", g, 1.0) for g, f in zip(a, b)}
    used = {x[1] for x in out.values()}
    pairs = sorted((-like(before[g], after[f]), g, f) for g in gone for f in fresh if g not in used and f not in out)
    for m, g, f in pairs:
        if -m >= least and g not in used and f not in out:
            out[f] = ("renamed", g, -m)
            used.add(g)
    for f in fresh:
        if f not in out:
            m, g = min((-like(t, after[f]), g) for g, t in before.items())
            out[f] = ("copied", g, -m) if -m >= least else ("added", None, None)
    out |= {k: ("modified", None, None) for k in after.keys() & before.keys() if after[k] != before[k]}
    return out


def test_moves_against_all_pairs(spark):
    import random

    from corpusqa.operators import gates

    rng = random.Random(12)
    text = lambda: "\n".join(rng.choice(["甲", "乙", "丙", "丁", "", " 戊 ", f"{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 9)))
    before = {("b", i): text() for i in range(40)}
    after = {}
    for (c, i), t in before.items():
        kind = rng.random()
        if kind < 0.3:
            continue
        parts = t.split("\n")
        parts[rng.randrange(len(parts))] = "new"
        after[(c, i) if kind < 0.6 else (c, i + 100)] = t if kind < 0.45 or kind > 0.85 else "\n".join(parts)
    for i in range(200, 215):
        after["b", i] = rng.choice(list(before.values())) if i % 3 else text()
    schema = "corpus STRING, seq BIGINT, text STRING"
    frames = [spark.createDataFrame([(*k, t) for k, t in side.items()], schema) for side in (before, after)]
    got = {(r.corpus, r.seq): (r.status, (r.from_corpus, r.from_seq) if r.from_corpus else None, r.likeness) for r in gates.moved_sections(*frames, ["corpus", "seq"]).collect()}
    assert got == brute_moves(before, after)
    assert {x[0] for x in got.values()} == {"renamed", "copied", "added", "modified"}
    assert gates.moved_sections(frames[0].where("false"), frames[1], ["corpus", "seq"]).where("status <> 'added'").count() == 0
