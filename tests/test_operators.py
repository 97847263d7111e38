"""Operators on small inputs: CJK texts, nulls, ties, empties, invariants, mutations."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusqa import sources as src
from corpusqa.functions import text as fn
from corpusqa.operators import cadence, dups, gates, ledgers, lint, metrics, phrases, reconcile, rewrite
from corpusqa.plans.tables import values
from corpusqa.schemas import CJK, CUSTODY
from corpusqa.sources import nested

SEC = "corpus STRING, seq BIGINT, text STRING"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_char_count_and_titles(spark):
    df = spark.createDataFrame([("# 第1章《开端》\n他　说：你好\n",), (None,), ("",), ("plain",)], "t STRING")
    got = df.select(fn.char_count(F.col("t")), fn.section_title(F.col("t"), F.lit("id"))).collect()
    assert [tuple(r) for r in got] == [(5, "开端"), (0, "id"), (0, "id"), (5, "id")]


def test_own_attribution_and_shift(spark):
    df = spark.createDataFrame([("“走。”他说",), ("“走。”",), ("次日清晨",), ("次日" + "长" * 30,)], "p STRING")
    got = df.select(fn.has_own_attribution(F.col("p")), fn.is_scene_shift(F.col("p"), CJK.scene)).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, False)]


def test_read_sections_orders_by_number(spark, tmp_path):
    book = tmp_path / "book"
    book.mkdir()
    for name in ("chapter-2.md", "chapter-10.md", "chapter-100.md", "notes.md", "chapter-x.md"):
        (book / name).write_text(f"# {name}\n", encoding="utf-8")
    got = src.read_sections(spark, str(tmp_path))
    assert rows(got.select("corpus", "seq")) == [("book", 2), ("book", 10), ("book", 100)]


def test_read_ledger_keeps_corrupt_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"chains": [{"id": "c", "steps": [{"ch": 1, "holder": "h", "anchors": ["x"], "handover": []}], "terminal": {"ch": 2, "why": "w", "forbid_after": ["y"]}}]}')
    (tmp_path / "b.json").write_text("{broken")
    got = src.read_ledger(spark, str(tmp_path), CUSTODY).cache()
    assert got.count() == 2
    assert got.where("_corrupt_record IS NOT NULL").count() == 1


def test_numbered_matches_row_number(spark):
    data = [(f"c{i % 3 if i % 5 else 0}", i * 7 % 1000, str(i)) for i in range(1000)]
    df = spark.createDataFrame(data, "corpus STRING, k BIGINT, text STRING")
    got = {(r.corpus, r.k): r.seq for r in src.numbered(df, "corpus", "k").collect()}
    for c in ("c0", "c1", "c2"):
        keys = sorted(k for x, k, _ in data if x == c)
        assert [got[c, k] for k in keys] == list(range(1, len(keys) + 1))


def test_volumes_and_numerals(spark):
    df = spark.createDataFrame([("b", "第十二卷：30章（第285—314章）\n第2卷：x（第11—20章）\n无关")], "corpus STRING, text STRING")
    assert rows(src.volumes_from_text(df)) == [("b", 2, 11, 20), ("b", 12, 285, 314)]


def test_mentions_agree_and_cadence_keeps_absent_names(spark):
    s = spark.createDataFrame([("b", i, t) for i, t in enumerate(["王五来了\n王五走", "无", "老王在此\n假王五", "无", "王五"], 1)], SEC)
    r = spark.createDataFrame([("王五", ["老王"], ["假"]), ("赵六", [], [])], "name STRING, aliases ARRAY<STRING>, neg ARRAY<STRING>")
    found = cadence.mentions(s, r)
    assert rows(found) == [("b", "王五", 1, 2), ("b", "王五", 3, 1), ("b", "王五", 5, 1)]
    assert rows(cadence.mentions_by_prefix(s, r, 2)) == rows(found)
    assert rows(cadence.cadence(found, r, s)) == [("b", "王五", 3, 4, 1, 5, 2, 0), ("b", "赵六", 0, 0, None, None, None, None)]


def test_custody_mutation_gives_one_finding(spark):
    s = spark.createDataFrame([("b", 1, "剑在甲手"), ("b", 2, "甲交剑给乙")], SEC)
    def run(anchor):
        steps = spark.createDataFrame([("b", "剑", 1, "甲", ["剑"], ["交"]), ("b", "剑", 2, "乙", [anchor], [])], "corpus STRING, chain STRING, ch BIGINT, holder STRING, anchors ARRAY<STRING>, handover ARRAY<STRING>")
        st = ledgers.custody_status(steps, s, s.select("corpus", "seq"), 1, 10)
        return ledgers.custody_anchor(st, s).count(), ledgers.custody_handover(st, s).count()
    assert run("剑") == (0, 0)
    assert run("刀") == (1, 0)


def test_speech_needs_verb_and_is_not_address(spark):
    s = spark.createDataFrame([("b", 1, "王五说：“走。”"), ("b", 2, "他对王五说：“走。”"), ("b", 3, "“走。”王五道")], SEC)
    got = dups.speech_hits(s, spark.createDataFrame([("王五",)], "name STRING"), CJK)
    assert rows(got.select("seq")) == [(1,), (3,)]
    far = spark.createDataFrame([("b", 1, "王五说了一句很长的话：“走。”"), ("b", 2, "“走。”他想了想，王五喊。"), ("b", 3, "“走。”他走了。王五喊。")], SEC)
    assert rows(dups.speech_hits(far, spark.createDataFrame([("王五",)], "name STRING"), CJK).select("seq")) == [(2,)]


def test_section_repeats_strict_needs_apart(spark):
    s = spark.createDataFrame([("b", 1, "abababab"), ("b", 2, "abcdxxabcd"), ("b", 3, None), ("b", 4, "")], SEC)
    assert {r[1] for r in rows(dups.section_repeats(s, 4))} == {1, 2}
    assert {(r[1], r[2]) for r in rows(dups.section_repeats(s, 4, apart=True))} == {(1, "abab"), (2, "abcd")}


def test_lint_on_a_small_document(spark):
    text = "# T\n### A\n- **name：** x\n- **name：** y\n- **role:** z\n### A\n- **k：** v\n## B ## C\n|a|b|\n|-|-|\n|1|\n(x\n"
    docs = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "doc STRING, text STRING")
    lines = lint.doc_lines(docs)
    assert [r.line for r in lint.lint_level_jump(lines).collect()] == [1]
    assert [r.detail for r in lint.lint_dup_card(lines, person="^A$").collect()] == ["A@1"]
    named = lint.doc_lines(spark.createDataFrame([("d", "### 1. 张三（一）\n- **名：** x\n### 张三·二\n- **名：** y\n### 张\n- **名：** y\n### 张\n- **名：** y\n### A\n- **名：** y\n### A\n- **名：** y")], "doc STRING, text STRING"))
    assert [(r.line, r.detail) for r in lint.lint_dup_card(named).collect()] == [(2, "张三@0")]
    assert [r.line for r in lint.lint_dup_field(lines).collect()] == [3]
    assert [r.line for r in lint.lint_colon(lines).collect()] == [4]
    assert [r.line for r in lint.lint_glued(lines).collect()] == [7]
    assert [r.line for r in lint.lint_table_columns(docs).collect()] == [10]
    assert [r.line for r in lint.lint_quotes(docs).collect()] == [11]


@pytest.mark.parametrize("text,line", [("a)\n(b", None), (")\n(\n(", 0), ("(\n()\n", 0), ("()\n(\n", 1)])
def test_quote_line(spark, text, line):
    got = lint.lint_quotes(spark.createDataFrame([("d", text)], "doc STRING, text STRING")).collect()
    assert [r.line for r in got] == ([] if line is None else [line])


def test_upsert_segment_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "# H\r\nbody"), (2, "body"), (3, "x\n<b>\nold\n<e>\ny"), (4, None)], "doc INT, text STRING")
    segments = spark.createDataFrame([(1, "s\nt"), (2, "s"), (3, "n")], "doc INT, segment STRING")
    once = rewrite.upsert_segment(docs, segments, "<b>", "<e>").cache()
    assert dict(rows(once))[1] == "# H\r\n<b>\r\ns\r\nt\r\n<e>\r\nbody"
    assert dict(rows(once))[3] == "x\n<b>\nn\n<e>\ny"
    assert rows(rewrite.upsert_segment(once, segments, "<b>", "<e>")) == rows(once)


def test_coalesce_folds_a_section_once(spark):
    """The fold is no part of a lambda, which would run it for each paragraph."""
    plan = rewrite.coalesce_paragraphs(spark.createDataFrame([("a", 1, "甲。\n乙。")], SEC))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan
    assert not any("aggregate(" in line[line.find("lambdafunction(") :] for line in plan.split("\n") if "lambdafunction(" in line)


def test_coalesce_keeps_text(spark):
    text = "短句。\n又一句。\n他道：\n“走。”\n次日\n“开口\n未完”\n末段。"
    s = spark.createDataFrame([("b", 1, text), ("b", 2, ""), ("b", 3, None)], SEC)
    got = {r.seq: r.text for r in rewrite.coalesce_paragraphs(s).collect()}
    assert got[1].replace("\n", "") == text.replace("\n", "")
    assert got[1].split("\n") == ["短句。又一句。他道：“走。”", "次日", "“开口", "未完”", "末段。"]


@pytest.mark.parametrize(
    "paras,expected",
    [
        (["他道：", "“走。”", "他走了很远。", "末。"], ["他道：“走。”他走了很远。", "末。"]),
        (["甲。", "“去。”乙道", "丙走了。", "末。"], ["甲。", "“去。”乙道丙走了。", "末。"]),
        (["甲。", "“去。”", "丙走了。", "末。"], ["甲。", "“去。”", "丙走了。", "末。"]),
        (["甲。", "他停了。“不知。”", "末。"], ["甲。", "他停了。“不知。”", "末。"]),
        (["甲。", "他道“不知。”", "末。"], ["甲。他道“不知。”", "末。"]),
        (["甲。", "三月初一", "乙。", "末。"], ["甲。", "三月初一乙。", "末。"]),
        (["甲:", "“去。”", "末。"], ["甲:", "“去。”", "末。"]),
        (["甲。", "“一", "二", "三”", "乙。", "丙。", "末。"], ["甲。", "“一", "二", "三”", "乙。丙。", "末。"]),
    ],
)
def test_coalescing_rules(spark, paras, expected):
    got = coalesced(spark, paras)
    assert "".join(got) == "".join(paras)
    assert got == expected


def coalesced(spark, paras, target=110):
    s = spark.createDataFrame([("b", 1, "\n".join(paras))], SEC)
    return rewrite.coalesce_paragraphs(s, target, CJK).first().text.split("\n")


def test_long_paragraphs_take_no_more(spark):
    long = "字 " * 109 + "字"
    assert coalesced(spark, [long, "乙。", "末。"]) == [long, "乙。", "末。"]
    assert coalesced(spark, [long, "乙。", "末。"], 111) == [long + "乙。", "末。"]


def test_coalescing_leaves_headings_and_indents_out(spark):
    assert coalesced(spark, ["# 第1章《T》", "他走了。", "天黑了。", "末。"]) == ["# 第1章《T》", "他走了。天黑了。", "末。"]
    assert coalesced(spark, ["　　“走。”他说。", "　　", "## 二", "\xa0丙走了。\r", "末。"]) == ["## 二", "“走。”他说。丙走了。", "末。"]
    assert coalesced(spark, ["# 只有题"]) == ["# 只有题"]
    many = [f"{i}。" for i in range(3000)]  # flags in several pieces
    got = coalesced(spark, many)
    assert "".join(got) == "".join(many) and got == brute_narrative(many)


def brute_narrative(paras, target=110):
    out, n = [paras[0]], len(paras[0])
    for i, p in enumerate(paras[1:], 1):
        if i < len(paras) - 1 and n < target:
            out[-1], n = out[-1] + p, n + len(p)
        else:
            out.append(p)
            n = len(p)
    return out


def test_full_width_white_space(spark):
    s = spark.createDataFrame([("b", 1, "　　“走。”他说。\n　　\n　\u00a0他走了很远\u3000很远。\n# 题 不是甲而是乙\n　# 缩进\n——\n“……………………”\n不是甲而是乙乙乙乙乙乙。"), ("b", 2, None), ("b", 3, "")], SEC)
    got = [(r.pos, r.para, r.kind, r.n_chars) for r in metrics.paragraphs(s, CJK).orderBy("pos").collect()]
    assert got == [(0, "“走。”他说。", "quote", 7), (2, "他走了很远\u3000很远。", "narrative", 8), (5, "——", "narrative", 2), (6, "“……………………”", "quote", 10), (7, "不是甲而是乙乙乙乙乙乙。", "narrative", 12)]
    assert sorted(r.sent for r in metrics.sentences(s, 2, CJK).collect()) == sorted(["”他说", "他走了很远很远", "不是甲而是乙乙乙乙乙乙", "“走"])
    stats = {r.seq: (r.n_all, r.chars_all, r.n_quote, r.chars_narrative) for r in metrics.paragraph_stats(s, CJK).collect()}
    assert stats == {1: (5, 39, 2, 22)}
    assert [(r.seq, r.hits, r.chars) for r in metrics.pattern_density(s, CJK.negation).orderBy("seq").collect()] == [(1, 1, 42), (2, 0, 0), (3, 0, 0)]
    m = {r.seq: (r.chars, r.hits, r.n_all, len(r.sents)) for r in metrics.measure(s, ["corpus", "seq"], CJK).collect()}
    assert m == {1: (42, 1, 5, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


ROSTER = "name STRING, aliases ARRAY<STRING>, neg ARRAY<STRING>"


@pytest.mark.parametrize("shard_chars", [1 << 20, 40])
def test_mentions_of_many_forms(spark, monkeypatch, shard_chars):
    """Text without spaces, forms that contain and overlap each other, contexts; one automaton and shards."""
    import random

    from corpusqa.operators import phrases

    monkeypatch.setattr(phrases.phrase_hits, "__defaults__", (*phrases.phrase_hits.__defaults__[:-1], shard_chars))
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("甲乙丙丁é") for _ in range(rng.randint(a, b)))
    roster = [(f"{word(1, 4)}", [word(2, 3) for _ in range(rng.randint(0, 2))] if i % 3 else None, [word(2, 3)] if i % 4 == 0 else None) for i in range(40)]
    roster = list({r[0]: r for r in roster}.values()) + [("", [], []), ("戊", [None, ""], [None, ""])]
    texts = [("b", i, "\n".join(word(0, 12) for _ in range(5))) for i in range(1, 30)] + [("c", 1, None), ("c", 2, ""), ("c", 3, "戊\n\n戊")]
    expected = set()
    for corpus, seq, text in texts:
        for name, aliases, neg in roster:
            forms, no = [f for f in [name, *(aliases or [])] if f], [x for x in neg or [] if x]
            n = sum(any(f in line for f in forms) and not any(x in line for x in no) for line in (text or "").split("\n"))
            if n:
                expected.add((corpus, name, seq, n))
    s, r = spark.createDataFrame(texts, SEC), spark.createDataFrame(roster, ROSTER)
    found = cadence.mentions(s, r)
    assert {(x.corpus, x["name"], x.seq, x.lines) for x in found.collect()} == expected
    assert not any(x in found._jdf.queryExecution().toString() for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))
    named = r.where("name <> ''")
    assert rows(cadence.mentions_by_prefix(s, named)) == rows(cadence.mentions(s, named))


def test_speech_by_alias(spark):
    s = spark.createDataFrame([("b", 1, "小五说：“走。”"), ("b", 2, "“走。”王五道。"), ("b", 3, "他对小五说：“走。”"), ("b", 4, "小五走了。")], SEC)
    r = spark.createDataFrame([("王五", ["小五", None], None), ("李\\E四", None, None)], ROSTER)
    assert sorted((x.seq, x["name"], x.n) for x in dups.speech_hits(s, r).collect()) == [(1, "王五", 1), (2, "王五", 1)]


def test_cards_and_their_coverage(spark):
    text = "# 人物卡\r\n### 1. 王五（主角）\r\n### 朝堂人物\n#### 李四 已故\n### 赵六：说明\n##### 孙七\n### A\n### 1. 王五（主角）\n### 2b、周八／周九"
    docs = spark.createDataFrame([("x", text), ("y", None), ("z", "")], "doc STRING, text STRING")
    cards = ledgers.character_cards(docs)
    assert sorted((r.card, r.tokens) for r in cards.collect()) == [("周八／周九", ["周八", "周九"]), ("李四 已故", ["李四"]), ("王五（主角）", ["王五", "主角"])]
    plan = spark.createDataFrame([("卷十三周九出场",), (None,)], "text STRING")
    assert sorted(r.card for r in ledgers.uncovered_cards(cards, plan).collect()) == ["李四 已故", "王五（主角）"]


def test_covering_ranges(spark):
    """Overlapping, nested, empty, open and huge ranges, with and without keys."""
    import random

    from corpusqa.operators.intervals import covering, product, until_next

    rng = random.Random(6)
    points = [(rng.choice("xy"), p) for p in [rng.randint(-50, 300) for _ in range(60)] + [None, 0, -(1 << 62), (1 << 62) + 1, (1 << 63) - 1]]
    ranges = [(rng.choice("xy"), a, a + rng.choice([0, 0, 1, 3, 17, 64, 500]), i) for i, a in enumerate(rng.randint(-60, 300) for _ in range(50))]
    ranges += [("x", -(1 << 63), (1 << 63) - 1, 98), ("y", 5, 3, 99), ("x", None, 5, 100), ("y", 1, None, 101)]
    p, r = spark.createDataFrame(points, "k STRING, seq BIGINT"), spark.createDataFrame(ranges, "k STRING, lo BIGINT, hi BIGINT, id INT")
    hold = lambda x, row: x is not None and row[1] is not None and row[2] is not None and row[1] <= x <= row[2]
    keyed = covering(p, r, keys=("k",))
    assert {(x.k, x.seq, x.id) for x in keyed.collect()} == {(k, x, row[3]) for k, x in points for row in ranges if row[0] == k and hold(x, row)}
    free = covering(p, r.drop("k"))
    assert sorted((x.seq, x.id) for x in free.collect()) == sorted({(x, row[3]) for _, x in points for row in ranges if hold(x, row)})
    for df in (keyed, free):
        assert not any(x in df._jdf.queryExecution().toString() for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))
    assert covering(p, r.where("false")).count() == 0
    starts = spark.createDataFrame([(5, "b"), (1, "a"), (9, "c")], "start BIGINT, name STRING")
    assert sorted((x.start, x.hi) for x in until_next(starts).collect()) == [(1, 4), (5, 8), (9, (1 << 63) - 1)]
    days = spark.createDataFrame([("2020-01-01", "2020-02-01", 1)], "lo STRING, hi STRING, id INT").selectExpr("date(lo) lo", "date(hi) hi", "id")
    day = spark.createDataFrame([("2020-01-31",), ("2020-02-02",)], "seq STRING").selectExpr("date(seq) seq")
    assert [x.id for x in covering(day, days).collect()] == [1]
    assert product(p.select("seq"), r.select("id")).count() == len(points) * len(ranges)


def test_bucket_of_each_kind(spark):
    starts = spark.createDataFrame([("a", 1, "a1"), ("a", 10, "a10"), ("b", 5, "b5")], "kind STRING, start BIGINT, name STRING")
    df = spark.createDataFrame([(0,), (1,), (7,), (10,), (99,)], "seq BIGINT")
    got = sorted((r.seq, r["name"] or "") for r in reconcile.bucket_of(df, starts).collect())
    assert got == [(0, ""), (1, "a1"), (7, "a1"), (7, "b5"), (10, "a10"), (10, "b5"), (99, "a10"), (99, "b5")]


def test_short_names_are_met_by_prefix(spark):
    s = spark.createDataFrame([("b", 1, "王五来了\n李"), ("b", 2, "欧阳修远")], SEC)
    r = spark.createDataFrame([("王五", [], []), ("欧阳修远之", ["李"], []), ("欧阳修远", [], [])], "name STRING, aliases ARRAY<STRING>, neg ARRAY<STRING>")
    assert rows(cadence.mentions_by_prefix(s, r)) == rows(cadence.mentions(s, r)) != []


def test_compact_ranges_expand_again(spark):
    values = [1, 2, 3, 7, 9, 10, 10, 15]
    df = spark.createDataFrame([("p", v) for v in values], "p STRING, n BIGINT")
    got = gates.compact_ranges(df, "p", "n", 10).first()
    expanded = [k for r in got.ranges.split(",") for k in range(int(r.split("-")[0]), int(r.split("-")[-1]) + 1)]
    assert expanded == sorted(set(values)) and got.more == 0
    assert gates.compact_ranges(df, "p", "n", 2).first().more == 2


def test_upsert_keeps_keys_unique(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k INT, v STRING, o INT")
    assert rows(src.upsert(base, new, "k", "o")) == [(1, "a"), (2, "d"), (3, "e")]


def test_ratchet(spark):
    now = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name STRING, value BIGINT")
    base = spark.createDataFrame([("a", 4), ("b", 5)], "name STRING, value BIGINT")
    assert {(r.name, r.status) for r in cadence.ratchet(now, base, ["name"], "value").collect()} == {("a", "worse"), ("b", "pass"), ("c", "new")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SEC)
    assert metrics.paragraph_stats(none).count() == 0
    assert reconcile.sequence_gaps(none).count() == 0
    assert metrics.repeated_sentences(none).count() == 0
    assert src.sections_from_table(spark.createDataFrame([], "source STRING, doc_id BIGINT, text STRING"), "source", "doc_id", "text").count() == 0


def test_same_result_for_other_shuffle_partitions(spark, sf_dir):
    from corpusqa.plans.registry import queries

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(queries()["c9_top_repeated_sentences"](spark, sf_dir)))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_life_steps_and_verdicts(spark):
    people = spark.createDataFrame(
        [("a", 700, 750, [(1, 690, None), (2, None, None), (2, None, "reported"), (None, 1, None)], [(9, 720, None)], 3, None), ("b", None, None, [(3, 800, None), (3, 779, None)], [], None, None)],
        "name STRING, born BIGINT, ends BIGINT, landed ARRAY<STRUCT<seq BIGINT, year BIGINT, carrier STRING>>, planned ARRAY<STRUCT<seq BIGINT, year BIGINT, carrier STRING>>, first BIGINT, last BIGINT",
    )
    sections = spark.createDataFrame([("x", i, "") for i in (1, 2, 3, 4)], "corpus STRING, seq BIGINT, text STRING")
    spans = spark.createDataFrame([(1, 1, 700, 710), (2, 2, 745, 755), (4, 8, 800, 810)], "lo BIGINT, hi BIGINT, year_lo BIGINT, year_hi BIGINT")
    steps = ledgers.life_steps(people).withColumn("corpus", F.lit("x"))
    got = ledgers.life_verdicts(steps, people.select("name", "born", "ends"), sections, spans, 779)
    assert sorted((r["name"], r.seq, r.kind) for r in got.collect() if r.seq) == [("a", 1, "before_birth"), ("a", 2, "reaches_past"), ("a", 3, "no_span"), ("b", 3, "no_span"), ("b", 3, "no_span")]
    assert [r["name"] for r in got.where("kind = 'undated'").collect()] == ["a"]
    wide = spans.union(spark.createDataFrame([(3, 3, 700, 710)], spans.schema))
    late = ledgers.life_verdicts(steps, people.select("name", "born", "ends"), sections, wide, 779).where("name = 'b'")
    assert [(r.year, r.kind) for r in late.collect()] == [(800, "after_end")]  # no year of death: the work's last year


def test_plantings_that_stand(spark):
    rows = spark.createDataFrame([("已在案",), ("ch 285",), ("ch286、卷十三",), ("卷十二",), ("待定",), ("",), ("ch9999999999999999999999",)], "anchor STRING")
    assert [r[0] for r in rows.select(ledgers.planting_stands("anchor", 285, 12)).collect()] == [True, True, False, True, False, False, False]


def test_titles_by_volume(spark):
    declared = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d"), (1, 9, "z")], "vol BIGINT, id BIGINT, title STRING")
    actual = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (5, ""), (20, "q")], "id BIGINT, title STRING")
    got = {(r.id, r.status, r.severity) for r in reconcile.title_reconcile(declared, actual).collect()}
    assert got == {(2, "mismatch", "fail"), (4, "section_missing", "fail"), (9, "section_missing", "warn"), (4, "beyond_source", "warn"), (9, "beyond_source", "warn"), (3, "undeclared", "warn"), (5, "undeclared", "warn")}
    assert {r.severity for r in reconcile.title_reconcile(declared, actual, True).where("status = 'section_missing'").collect()} == {"warn"}


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_scans_over_cells(spark, bits):
    import itertools
    import random

    from corpusqa.operators.scans import previous, running_sum

    rng = random.Random(bits)
    numbers = {p: sorted(rng.sample(range(-40, 200), 60)) for p in ("x", "y", None)}
    df = spark.createDataFrame([(p, n) for p, ns in numbers.items() for n in ns], "p STRING, n BIGINT")
    before = {(r.p, r.n): r.before for r in previous(df, ["p"], "n", bits=bits).collect()}
    sums = {(r.p, r.n): r.s for r in running_sum(df, ["p"], "n", F.col("n") % 3, "s", bits).collect()}
    rem = lambda n: int(__import__("math").fmod(n, 3))
    for p, ns in numbers.items():
        assert [before[p, n] for n in ns] == [None, *ns[:-1]]
        assert [sums[p, n] for n in ns] == list(itertools.accumulate(map(rem, ns)))
    runs = {r.p: (r.ranges, r.more) for r in gates.compact_ranges(df, "p", "n", 1000, bits).collect() if r.p}
    for p in ("x", "y"):
        assert sum(a != b - 1 for a, b in itertools.pairwise(numbers[p])) + 1 == len(__import__("re").findall(r"(?:^|,)", runs[p][0]))


def test_matrices_as_of_many(spark):
    facts = spark.createDataFrame([("p", "s", 3, "half"), ("p", "s", 9, "knows"), ("q", "s", 5, "not"), ("q", "t", 1, "wrong"), ("q", "t", 1, "half")], "person STRING, secret STRING, seq BIGINT, state STRING")
    as_of = spark.createDataFrame([(0,), (4,), (9,), (100,)], "seq BIGINT")
    got = sorted((r.seq, r.person, r.s, r.t) for r in ledgers.knowledge_matrices(facts, ["s", "t"], as_of).collect())
    assert got == [(4, "p", "half", None), (4, "q", None, "wrong"), (9, "p", "knows", None), (9, "q", "not", "wrong"), (100, "p", "knows", None), (100, "q", "not", "wrong")]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_lint_sorts_no_texts_of_lines(spark):
    plan = optimized(lint.lint_all(spark.createDataFrame([("d", "plain\n# c1\n- **name：** x")], "doc STRING, text STRING"), ("name",)))
    below = max(i for i, line in enumerate(plan) if "Window [" in line) + 1
    assert "Project [" in plan[below] and not any(c.strip().startswith("line#") for c in plan[below].replace("Project [", "").split(", "))
    plain = [("d", "a\n" * 3 + "| a | b |\nx\n| a |\n| a | b |\n")]  # a row alone, then a run of two
    assert rows(lint.lint_all(spark.createDataFrame(plain, "doc STRING, text STRING"), ("name",))) == [("d", "table_columns", 6, "4/3")]


def test_steps_meet_sections_once_by_their_whole_key(spark):
    steps = spark.createDataFrame([("a", 1, 1, 5, "in_person"), ("a", 1, None, None, "in_person"), ("a", 2, 9, 5, "in_person"), ("a", 2, 3, 5, "in_person")], "corpus STRING, name BIGINT, seq BIGINT, year BIGINT, carrier STRING")
    people = spark.createDataFrame([(1, 6, 9), (2, 1, 4)], "name BIGINT, born BIGINT, ends BIGINT")
    there = spark.createDataFrame([("a", 1), ("a", 3)], "corpus STRING, seq BIGINT")
    out = ledgers.life_verdicts(steps, people, there, spark.createDataFrame([(1, 2, 5, 6)], "lo BIGINT, hi BIGINT, year_lo BIGINT, year_hi BIGINT"), 99)
    assert rows(out.select("name", "kind")) == [(1, "before_birth"), (1, "undated"), (2, "no_span")]
    assert sum("carrier#" in line and "LogicalRDD" in line for line in optimized(out)) == 3


def test_life_steps_leave_the_json_in_one_pass(spark):
    tables = nested.life_windows(spark.createDataFrame([("a", '{"people": [{"name": "n", "landed": [{"chapter": 1}], "planned": [{"chapter": 2, "kind": "reported"}], "landed_range": {"first": 3}}, {"name": "m", "landed": 1}]}')], "corpus STRING, json STRING"), spark.createDataFrame([("a",)], "corpus STRING"))
    assert rows(tables["landings"].select("name", "phase", "seq", "carrier")) == [("n", "landed", 1, "in_person"), ("n", "planned", 2, "reported"), ("n", "range", 3, "in_person")]
    assert rows(tables["findings"].select("subject")) == [("$.people[1].landed",)]
    assert sum("LogicalRDD" in line for line in optimized(tables["landings"])) == 1


def test_pieces_of_no_names_are_dropped_before_the_shuffle(spark):
    names = [("甲乙丙丁戊", [], []), ("ab", ["𠀀𠀁"], ["zz"]), ("x\ny", [], [])]
    roster = spark.createDataFrame(names, "name STRING, aliases ARRAY<STRING>, neg ARRAY<STRING>")
    s = spark.createDataFrame([("c", 1, "说甲乙丙丁戊\nzz ab\n𠀀𠀁ab"), ("c", 2, "a"), ("c", 3, None), ("c", 4, "甲乙丙丁 ab𠀀𠀁")], SEC)
    out = cadence.mentions_by_prefix(s, roster)
    assert rows(out) == rows(cadence.mentions(s, roster)) == [("c", "ab", 1, 1), ("c", "ab", 4, 1), ("c", "甲乙丙丁戊", 1, 1)]
    assert any("Join LeftSemi" in line for line in optimized(out))


def test_phrases_hold_little_text_at_a_time(spark):
    texts = ["x" * 1000] * 3000 + ["y" * (3 * phrases.PIECE_BYTES), None, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    pieces = list(phrases._pieces(batch, 1))
    assert sum((p.column(1).to_pylist() for p in pieces), []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= phrases.PIECE_BYTES for p in pieces)


def test_parameter_tables_need_no_python_worker(spark):
    held = values(spark, "name STRING, aliases ARRAY<STRING>, n BIGINT", ("a", ["b"], 1), ("c", [], None))
    assert rows(held) == [("a", ["b"], 1), ("c", [], None)]
    assert not any("RDD" in line for line in optimized(held))
