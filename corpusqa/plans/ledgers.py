"""Queries E1-E4, F1-F15, K1-K5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.operators import cadence, dups, ledgers, metrics
from corpusqa.plans.metrics import SPEAKER_VALUES, SPEAKERS, SPEECH, SPOKEN
from corpusqa.plans.registry import query
from corpusqa.plans.tables import SEC, SENTS, sections, table, values
from corpusqa.sources import cut, nested, scratch

NAMES = ("Eriner", "Nicht", "Thedre", "Thble", "Zzzz")
ROSTER_SQL = "r(name) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"
MENTIONS = f"{SEC}, {ROSTER_SQL}, ln AS (SELECT corpus, seq, unnest(string_split(text, chr(10))) AS line FROM sec), men AS (SELECT corpus, name, seq, count(*) AS lines FROM ln JOIN r ON (contains(line, name) OR (name = 'Nicht' AND contains(line, 'Einer'))) AND NOT contains(line, '%%%') GROUP BY ALL)"
CADENCE = f"{MENTIONS}, lagged AS (SELECT *, seq - lag(seq) OVER (PARTITION BY corpus, name ORDER BY seq) AS gap FROM men), ag AS (SELECT corpus, name, count(*) AS sections, sum(lines)::BIGINT AS lines, min(seq) AS first, max(seq) AS last, coalesce(max(gap), 0) AS max_gap FROM lagged GROUP BY ALL), en AS (SELECT corpus, max(seq) AS e FROM sec GROUP BY corpus), cad AS (SELECT en.corpus, r.name, coalesce(sections, 0) AS sections, coalesce(lines, 0) AS lines, first, last, max_gap, e - last AS tail_gap FROM en CROSS JOIN r LEFT JOIN ag ON ag.corpus = en.corpus AND ag.name = r.name)"


def roster(spark: SparkSession) -> DataFrame:
    return values(spark, "name STRING, aliases ARRAY<STRING>, neg ARRAY<STRING>", *((n, ["Einer"] if n == "Nicht" else [], ["%%%"]) for n in NAMES))


def found(spark: SparkSession, d: str) -> DataFrame:
    return cadence.mentions(sections(spark, d), roster(spark))


def rhythm(spark: SparkSession, d: str) -> DataFrame:
    return cadence.cadence(found(spark, d), roster(spark), sections(spark, d))


@query("e1_mentions", f"WITH {MENTIONS} SELECT * FROM men")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d)


@query("e1_mentions_by_prefix", f"WITH {MENTIONS} SELECT * FROM men")
def e1b(spark: SparkSession, d: str) -> DataFrame:
    return cadence.mentions_by_prefix(sections(spark, d), roster(spark))


@query("e2_cadence", f"WITH {CADENCE} SELECT * FROM cad")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return rhythm(spark, d)


VIOLATIONS = "SELECT corpus, name, 'gap' AS rule, max_gap AS value FROM cad WHERE max_gap >= 10 UNION ALL SELECT corpus, name, 'tail', tail_gap FROM cad WHERE tail_gap >= 10 UNION ALL SELECT corpus, name, 'zero', 0 FROM cad WHERE sections = 0"


@query("e3_cadence_violations", f"WITH {CADENCE} {VIOLATIONS}")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return cadence.cadence_violations(rhythm(spark, d), 10, 10)


@query(
    "e4_ratchet",
    f"WITH {CADENCE}, cur AS ({VIOLATIONS}), base AS (SELECT corpus, name, rule, value // 2 * 2 - CASE WHEN length(corpus) > 4 THEN 2 ELSE 0 END AS prior FROM cur WHERE name <> 'Thble') SELECT corpus, name, rule, prior, value, CASE WHEN prior IS NULL THEN 'new' WHEN value > prior THEN 'worse' ELSE 'pass' END AS status FROM cur LEFT JOIN base USING (corpus, name, rule)",
)
def e4(spark: SparkSession, d: str) -> DataFrame:
    now = cadence.cadence_violations(rhythm(spark, d), 10, 10)
    base = now.where("name <> 'Thble'").withColumn("value", F.expr("value div 2 * 2 - if(length(corpus) > 4, 2, 0)"))
    return cadence.ratchet(now, base, ["corpus", "name", "rule"], "value")


def steps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("corpus"), F.lit("talk").alias("chain"), F.col("turn").alias("ch"), F.col("role").alias("holder"), F.expr("if(turn % 5 = 4, array(), array('the', 'que'))").alias("anchors"), F.array(F.lit("der")).alias("handover"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn % 7 <> 6").select(F.col("conv_id").cast("string").alias("corpus"), F.col("turn").alias("seq"), "text")


def stated(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("turn % 14 = 6").select(F.col("conv_id").cast("string").alias("corpus"), F.col("turn").alias("seq"))
    return ledgers.custody_status(steps(spark, d), turns(spark, d), said, 1, 8)


CUSTODY = """st AS (SELECT conv_id::VARCHAR AS corpus, turn AS ch, role AS holder, text, CASE WHEN turn < 1 THEN 'bad_number' WHEN turn % 7 = 6 THEN CASE WHEN turn % 14 = 6 THEN 'pending' ELSE 'missing' END WHEN turn NOT BETWEEN 1 AND 8 THEN 'skipped' WHEN turn % 5 = 4 THEN 'no_anchor' ELSE 'active' END AS status FROM conversations)"""


@query("f1_custody_status", f"WITH {CUSTODY} SELECT corpus, ch, holder, status FROM st")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return stated(spark, d).select("corpus", "ch", "holder", "status")


@query("f2_custody_anchor", f"WITH {CUSTODY} SELECT corpus, 'talk' AS chain, ch, holder FROM st WHERE status = 'active' AND NOT contains(text, 'the') AND NOT contains(text, 'que')")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.custody_anchor(stated(spark, d), turns(spark, d))


@query(
    "f3_custody_handover",
    f"WITH {CUSTODY}, p AS (SELECT corpus, ch, holder, text, lag(ch) OVER w AS from_ch, lag(holder) OVER w AS h0, lag(text) OVER w AS t0 FROM st WHERE status = 'active' WINDOW w AS (PARTITION BY corpus ORDER BY ch)) SELECT corpus, 'talk' AS chain, from_ch, ch, 'no_evidence' AS kind FROM p WHERE h0 <> holder AND NOT contains(text, 'der') AND NOT contains(t0, 'der')",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.custody_handover(stated(spark, d), turns(spark, d))


@query(
    "f4_custody_terminal",
    f"WITH {SEC}, t(corpus, ch, f1, f2) AS (VALUES ('src0', 10, 'Thble', 'ment'), ('src1', 20, 'zzz', 'und'), ('src2', 5, 'que', 'the')) SELECT corpus, 'c' AS chain, 'after_end' AS kind, seq, CASE WHEN contains(text, f1) THEN f1 ELSE f2 END AS phrase FROM sec JOIN t USING (corpus) WHERE seq > ch AND (contains(text, f1) OR contains(text, f2)) UNION ALL SELECT 'src3', 'c', 'no_phrases', NULL, NULL",
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    ends = values(spark, "corpus STRING, chain STRING, ch BIGINT, forbid ARRAY<STRING>", ("src0", "c", 10, ["Thble", "ment"]), ("src1", "c", 20, ["zzz", "und"]), ("src2", "c", 5, ["que", "the"]), ("src3", "c", 7, []))
    return ledgers.custody_terminal(ends, sections(spark, d))


ONSET_ROWS = (("Eriner", 8), ("Nicht", 20), ("Thedre", None), ("Thble", 3))
ONSET_SQL = "o(name, fa) AS (VALUES ('Eriner', 8), ('Nicht', 20), ('Thedre', NULL), ('Thble', 3))"


def onsets(spark: SparkSession, d: str) -> DataFrame:
    rows = values(spark, "name STRING, first_appearance BIGINT", *ONSET_ROWS)
    return sections(spark, d).select("corpus").distinct().join(F.broadcast(rows))


@query("f5_onset_violations", f"WITH {MENTIONS}, {ONSET_SQL} SELECT corpus, name, 'appearance' AS kind, count(*) AS early, min(seq) AS first_seq FROM men JOIN o USING (name) WHERE fa IS NULL OR seq < fa GROUP BY corpus, name")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.onset_violations(onsets(spark, d), found(spark, d))


@query("f5_speech_onsets", f"WITH {SEC}, said AS ({SPOKEN.format(sec='sec', names=SPEAKER_VALUES)}) SELECT corpus, name, 'speech' AS kind, count(*) AS early, min(seq) AS first_seq FROM said WHERE seq < 30 GROUP BY corpus, name")
def f5b(spark: SparkSession, d: str) -> DataFrame:
    """Speech before its onset."""
    names = values(spark, "name STRING, first_appearance BIGINT, first_speech BIGINT", *((n, 1, 30) for n in SPEAKERS))
    s = sections(spark, d)
    said = dups.speech_hits(s, names.select("name"), SPEECH)
    ledger = s.select("corpus").distinct().crossJoin(F.broadcast(names))  # corpora by the short list
    return ledgers.onset_violations(ledger, said.select("corpus", "name", "seq"), said.select("corpus", "name", "seq")).where("kind = 'speech'")


@query(
    "f6_onset_closure",
    f"WITH {MENTIONS}, {ONSET_SQL}, c AS (SELECT DISTINCT corpus FROM sec) SELECT c.corpus, o.name, o.fa::BIGINT AS first_appearance, CASE WHEN fa IS NULL OR fa >= 15 THEN 'late' WHEN sec.seq IS NULL THEN 'pending' WHEN men.seq IS NOT NULL THEN 'met' ELSE 'missing' END AS status FROM c CROSS JOIN o LEFT JOIN sec ON sec.corpus = c.corpus AND sec.seq = o.fa LEFT JOIN men ON men.corpus = c.corpus AND men.name = o.name AND men.seq = o.fa",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.onset_closure(onsets(spark, d), found(spark, d), sections(spark, d), 15)


CLOSURE = f"{MENTIONS}, {ONSET_SQL}, c AS (SELECT DISTINCT corpus FROM sec), cl AS (SELECT c.corpus, o.name, o.fa::BIGINT AS first_appearance, CASE WHEN fa IS NULL OR fa >= 15 THEN 'late' WHEN sec.seq IS NULL THEN 'pending' WHEN men.seq IS NOT NULL THEN 'met' ELSE 'missing' END AS status FROM c CROSS JOIN o LEFT JOIN sec ON sec.corpus = c.corpus AND sec.seq = o.fa LEFT JOIN men ON men.corpus = c.corpus AND men.name = o.name AND men.seq = o.fa WHERE NOT (o.name = 'Nicht' AND c.corpus LIKE '%3'))"


@query("f6_onset_lateness", f"WITH {CLOSURE} SELECT corpus, count(*) AS entries, count(*) FILTER (status = 'late') AS late, count(*) FILTER (status = 'met') AS met, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'late') > 1 AS warn FROM cl GROUP BY corpus")
def f6b(spark: SparkSession, d: str) -> DataFrame:
    ledger = onsets(spark, d).where("NOT (name = 'Nicht' AND corpus LIKE '%3')")
    return ledgers.onset_lateness(ledgers.onset_closure(ledger, found(spark, d), sections(spark, d), 15), 1)


def lives(spark: SparkSession, d: str) -> DataFrame:
    landings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_shipdate").alias("at_lo"), F.expr("l_shipdate + interval 10 days").alias("at_hi"), (F.col("l_returnflag") == "R").alias("exempt"))
    people = table(spark, d, "orders").select(F.col("o_orderkey").alias("person"), F.col("o_orderdate").alias("born"), F.expr("o_orderdate + interval 90 days").alias("ends"))
    return ledgers.life_windows(landings, people, ["person"])


@query(
    "f7_life_windows",
    "WITH j AS (SELECT l_orderkey AS person, CASE WHEN l_shipdate < o_orderdate THEN 'before_birth' WHEN l_returnflag = 'R' THEN NULL WHEN l_shipdate > o_orderdate + INTERVAL 90 DAY THEN 'after_end' WHEN l_shipdate + INTERVAL 10 DAY > o_orderdate + INTERVAL 90 DAY THEN 'reaches_past' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT person, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY ALL",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    return lives(spark, d).groupBy("person", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f7_landing_years",
    f"WITH {SEC}, v(lo, hi, y0, y1) AS (VALUES (1, 10, 100, 101), (11, 30, 102, 110)), o(seq, y) AS (VALUES (7, 99), (12, 120)) SELECT corpus, sec.seq, coalesce(CASE WHEN doc_id % 5 = 0 THEN sec.seq + 50 END, o.y, y0)::BIGINT AS at_lo, coalesce(CASE WHEN doc_id % 5 = 0 THEN sec.seq + 50 END, o.y, y1)::BIGINT AS at_hi FROM sec LEFT JOIN o ON o.seq = sec.seq LEFT JOIN v ON sec.seq BETWEEN lo AND hi",
)
def f7b(spark: SparkSession, d: str) -> DataFrame:
    landings = sections(spark, d).select("corpus", "seq", F.expr("if(doc_id % 5 = 0, seq + 50, null)").alias("year"))
    over = values(spark, "seq BIGINT, year BIGINT", (7, 99), (12, 120))
    spans = values(spark, "lo BIGINT, hi BIGINT, year_lo BIGINT, year_hi BIGINT", (1, 10, 100, 101), (11, 30, 102, 110))
    return ledgers.landing_years(landings, over, spans).select("corpus", "seq", "at_lo", "at_hi")


LIFE_SPANS = ((1, 10, 1992, 1993), (11, 20, 1993, 1996), (21, 35, 1996, 1998))


@query(
    "f7_life_verdicts",
    f"WITH {SEC}, v(lo, hi, y0, y1) AS (VALUES (1, 10, 1992, 1993), (11, 20, 1993, 1996), (21, 35, 1996, 1998)), p AS (SELECT o_orderkey AS name, year(o_orderdate) AS born, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) + 1 END AS ends, 'src' || (o_custkey % 20) AS corpus FROM orders), "
    "st AS (SELECT l_orderkey AS name, CASE WHEN l_linenumber < 7 THEN l_partkey % 60 + 1 END AS seq, CASE WHEN l_returnflag = 'A' THEN year(l_shipdate) END AS y, l_suppkey % 7 = 0 AS l0 FROM lineitem), "
    "j AS (SELECT st.name, CASE WHEN st.seq IS NULL THEN 'undated' WHEN v.lo IS NULL THEN 'no_span' WHEN coalesce(y, y0) < born THEN 'before_birth' WHEN l0 THEN NULL WHEN coalesce(y, y0) > least(ends, 1997) THEN 'after_end' WHEN coalesce(y, y1) > least(ends, 1997) THEN 'reaches_past' END AS kind FROM st JOIN p USING (name) LEFT JOIN sec ON sec.corpus = p.corpus AND sec.seq = st.seq LEFT JOIN v ON st.seq BETWEEN v.lo AND v.hi WHERE st.seq IS NULL OR sec.seq IS NOT NULL) SELECT name, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY ALL",
)
def f7c(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.year("o_orderdate").alias("born"), F.expr("if(o_orderstatus = 'F', year(o_orderdate) + 1, null)").alias("ends"), F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("corpus"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.expr("if(l_linenumber < 7, l_partkey % 60 + 1, null)").alias("seq"), F.expr("if(l_returnflag = 'A', year(l_shipdate), null)").alias("year"), F.expr("if(l_suppkey % 7 = 0, 'document', 'in_person')").alias("carrier"))
    steps = lines.join(people.select("name", "corpus"), "name")
    spans = values(spark, "lo BIGINT, hi BIGINT, year_lo BIGINT, year_hi BIGINT", *LIFE_SPANS)
    verdicts = ledgers.life_verdicts(steps, people.drop("corpus"), sections(spark, d), spans, 1997)
    return verdicts.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


LEDGERS = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE conv_id % 9 NOT IN (4, 5)"


def custody_files(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A custody ledger of each conversation as a line of JSON files; some are absent, don't parse, or have chapters that are texts, or none."""
    c = table(spark, d, "conversations").where("conv_id % 9 <> 4")
    ch = F.expr("CASE WHEN turn % 13 = 5 THEN 'five' ELSE cast(turn AS string) END")
    step = F.struct("turn", F.struct(ch.alias("ch"), F.col("role").alias("holder"), F.expr("if(turn % 5 = 4, array(), array('the', 'que'))").alias("anchors"), F.array(F.lit("der")).alias("handover")).alias("step"))
    steps = F.transform(F.array_sort(F.collect_list(step)), lambda x: x["step"])
    chains = c.groupBy("conv_id").agg(steps.alias("steps"))  # a conversation's turns
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("corpus"), F.array(F.struct(F.lit("talk").alias("id"), "steps")).alias("chains")))
    broken = F.concat(F.lit('{"chains": 1, "corpus": "'), F.col("conv_id").cast("string"), F.lit('"}'))
    path = scratch(spark)
    chains.select(F.when(F.col("conv_id") % 9 == 5, broken).otherwise(line)).write.text(path)
    expected = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("corpus"))
    return nested.custody(nested.read_lines(spark, path), expected)


@query(
    "a2_custody_from_json",
    f"WITH l AS ({LEDGERS}) SELECT conv_id::VARCHAR AS corpus, CASE WHEN turn % 13 <> 5 THEN turn END AS ch, role AS holder, CASE WHEN turn % 13 = 5 OR turn < 1 THEN 'bad_number' WHEN turn % 7 = 6 THEN CASE WHEN turn % 14 = 6 THEN 'pending' ELSE 'missing' END WHEN turn NOT BETWEEN 1 AND 8 THEN 'skipped' WHEN turn % 5 = 4 THEN 'no_anchor' ELSE 'active' END AS status FROM l",
)
def a2_custody(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("turn % 14 = 6").select(F.col("conv_id").cast("string").alias("corpus"), F.col("turn").alias("seq"))
    return ledgers.custody_status(custody_files(spark, d)["steps"], turns(spark, d), said, 1, 8).select("corpus", "ch", "holder", "status")


@query(
    "a2_custody_faults",
    f"WITH l AS ({LEDGERS}), f AS (SELECT conv_id, 'custody_field' AS rule, 'fail' AS severity, '$.chains[0].steps[' || i || '].ch' AS subject FROM l WHERE turn % 13 = 5 UNION ALL SELECT DISTINCT conv_id, 'custody_field', 'fail', '$.chains' FROM conversations WHERE conv_id % 9 = 5 UNION ALL SELECT DISTINCT conv_id, 'custody_missing', 'info', NULL FROM conversations WHERE conv_id % 9 = 4) SELECT conv_id::VARCHAR AS corpus, rule, severity, NULL::BIGINT AS seq, subject, 1::BIGINT AS n, NULL::VARCHAR AS detail FROM f",
)
def a2_faults(spark: SparkSession, d: str) -> DataFrame:
    return custody_files(spark, d)["findings"]


@query(
    "a2_life_from_json",
    f"WITH {SEC}, v(lo, hi, y0, y1) AS (VALUES (1, 10, 1992, 1993), (11, 20, 1993, 1996), (21, 35, 1996, 1996)), p AS (SELECT o_orderkey AS name, year(o_orderdate) AS born, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) + 1 END AS ends, 'src' || (o_custkey % 20) AS corpus FROM orders), "
    "st AS (SELECT l_orderkey AS name, CASE WHEN l_linenumber < 7 THEN l_partkey % 60 + 1 END AS seq, CASE WHEN l_returnflag = 'A' THEN year(l_shipdate) END AS y, l_suppkey % 7 = 0 AS l0 FROM lineitem), "
    "j AS (SELECT st.name, CASE WHEN st.seq IS NULL THEN 'undated' WHEN v.lo IS NULL THEN 'no_span' WHEN coalesce(y, y0) < born THEN 'before_birth' WHEN l0 THEN NULL WHEN coalesce(y, y0) > least(ends, 1997) THEN 'after_end' WHEN coalesce(y, y1) > least(ends, 1997) THEN 'reaches_past' END AS kind FROM st JOIN p USING (name) LEFT JOIN sec ON sec.corpus = p.corpus AND sec.seq = st.seq LEFT JOIN v ON st.seq BETWEEN v.lo AND v.hi WHERE st.seq IS NULL OR sec.seq IS NOT NULL) SELECT name, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY ALL",
)
def a2_life(spark: SparkSession, d: str) -> DataFrame:
    """Each order is a person of a life ledger; ledgers are lines of JSON files and are read, unnested and judged."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.expr("if(l_linenumber < 7, l_partkey % 60 + 1, null)").alias("chapter"), F.expr("if(l_returnflag = 'A', year(l_shipdate), null)").alias("year"), F.expr("if(l_suppkey % 7 = 0, 'document', 'in_person')").alias("kind")).alias("x"))
    landed = lines.groupBy("o_orderkey").agg(F.collect_list("x").alias("landed"))
    person = F.struct(F.col("o_orderkey").alias("name"), F.year("o_orderdate").alias("birth_year"), F.expr("if(o_orderstatus = 'F', year(o_orderdate) + 1, null)").alias("death_year"), "landed")
    path = scratch(spark)
    corpus = F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string"))
    table(spark, d, "orders").join(landed, "o_orderkey").select(F.to_json(F.struct(corpus.alias("corpus"), F.array(person).alias("people")))).write.text(path)
    volumes = F.expr("array(named_struct('vol', 1, 'from', 1992, 'to', 1993, 'chapters', '1-10'), named_struct('vol', 2, 'from', 1993, 'to', 1996, 'chapters', '11—20'), named_struct('vol', 3, 'from', 1996, 'to', null, 'chapters', '21 – 35'))")
    corpora = table(spark, d, "documents").select(F.col("source").alias("corpus")).distinct()
    corpora.select(F.to_json(F.struct("corpus", volumes.alias("volume_years")))).write.mode("append").text(path)
    tables = nested.life_windows(nested.read_lines(spark, path), corpora)
    # Each table is read out of the JSON once, however often the verdicts ask for it.
    people = cut(tables["people"].select(F.col("name").cast("bigint").alias("name"), "born", "ends"))
    steps = cut(tables["landings"].select("corpus", F.col("name").cast("bigint").alias("name"), "seq", "year", "carrier"))
    verdicts = ledgers.life_verdicts(steps, people, sections(spark, d), cut(tables["spans"]), 1997)
    return verdicts.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


RANGES = "SELECT c_nationkey AS vol, min(c_custkey) AS lo, max(c_custkey) AS hi, count(*) AS y0, count(*) FILTER (c_acctbal > 0) AS y1 FROM customer"


@query(
    "f8_reconcile_ranges",
    f"WITH a AS ({RANGES} GROUP BY ALL), b AS ({RANGES} WHERE c_nationkey <> 3 AND (c_nationkey % 4 <> 1 OR c_acctbal > 0) GROUP BY ALL) SELECT coalesce(a.vol, b.vol)::BIGINT AS vol, CASE WHEN a.vol IS NULL THEN 'only_b' WHEN b.vol IS NULL THEN 'only_a' WHEN (a.lo, a.hi) IS DISTINCT FROM (b.lo, b.hi) THEN 'range' WHEN (a.y0, a.y1) IS DISTINCT FROM (b.y0, b.y1) THEN 'years' ELSE 'same' END AS status FROM a FULL JOIN b ON a.vol = b.vol",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    agg = lambda df: df.groupBy(F.col("c_nationkey").cast("bigint").alias("vol")).agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"), F.count(F.lit(1)).alias("y0"), F.count_if(F.col("c_acctbal") > 0).alias("y1"))
    c = table(spark, d, "customer")
    return ledgers.reconcile_ranges(agg(c), agg(c.where("c_nationkey <> 3 AND (c_nationkey % 4 <> 1 OR c_acctbal > 0)")))


@query(
    "f9_uncovered_cards",
    "WITH t AS (SELECT page_id AS card, unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[A-Za-z]{5,12}')) AS word FROM pages), w AS (SELECT DISTINCT word FROM t WHERE EXISTS (SELECT 1 FROM conversations WHERE contains(text, word))) SELECT DISTINCT card FROM t WHERE card NOT IN (SELECT card FROM t JOIN w USING (word))",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]{5,12}"), 0)
    cards = table(spark, d, "pages").select(F.col("page_id").alias("card"), words(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("tokens")).where("size(tokens) > 0")
    return ledgers.uncovered_cards(cards, table(spark, d, "conversations"))


PLANTINGS = (("Zzzz", "planted", 99, None), ("Thble", "draft", 12, None), ("Thedre", "draft", 99, 13), ("Eriner", "draft", 99, 12))
SEATS = f"{MENTIONS}, c AS (SELECT DISTINCT corpus FROM sec), p(name, status, anchor, volume) AS (VALUES ('Zzzz', 'planted', 99, NULL), ('Thble', 'draft', 12, NULL), ('Thedre', 'draft', 99, 13), ('Eriner', 'draft', 99, 12)), m AS (SELECT corpus, name, count(*) AS n FROM men WHERE seq <= 5 GROUP BY ALL), j AS (SELECT c.corpus, r.name, coalesce(n, 0) AS sections, coalesce(p.status IN ('planted', 'done') OR p.anchor <= 5 OR p.volume <= 12, false) AS planted FROM c CROSS JOIN r LEFT JOIN m ON m.corpus = c.corpus AND m.name = r.name LEFT JOIN p ON p.name = r.name), cl AS (SELECT *, CASE WHEN sections = 0 AND NOT planted THEN 'open' WHEN sections <= 1 THEN 'thin' ELSE 'closed' END AS verdict FROM j)"


def seats(spark: SparkSession, d: str) -> DataFrame:
    corpora = sections(spark, d).select("corpus").distinct()
    planted = corpora.join(F.broadcast(values(spark, "name STRING, status STRING, anchor BIGINT, volume BIGINT", *PLANTINGS)))
    return ledgers.seat_closure(corpora.join(F.broadcast(roster(spark).select("name"))), found(spark, d), planted, 5)


@query("f10_seat_closure", f"WITH {SEATS} SELECT * FROM cl")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return seats(spark, d)


@query("f10_seat_summary", f"WITH {SEATS} SELECT corpus, count(*) AS seats, count(*) FILTER (verdict = 'open') AS open, count(*) FILTER (sections <= 1) AS thin, count(*) FILTER (sections <= 1) > 2 AS warn FROM cl GROUP BY corpus")
def f10b(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.seat_summary(seats(spark, d), 2)


LIVES = "l AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A') AS landed, count(*) FILTER (l_returnflag = 'N') AS planned FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS name, CAST(o_orderdate AS DATE) + 90 AS ends, coalesce(landed, 0) AS landed, coalesce(planned, 0) AS planned, o_orderpriority = '1-URGENT' AS ranged, o_orderstatus = 'P' AS waiting, o_orderstatus = 'F' AS dies FROM orders LEFT JOIN l ON l.k = o_orderkey)"


def mortals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("landed"), F.collect_list(F.expr("if(l_returnflag = 'N', l_partkey, null)")).alias("planned"))
    people = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    return people.select(F.col("o_orderkey").alias("name"), F.date_add(F.to_date("o_orderdate"), 90).alias("ends"), F.coalesce("landed", F.lit(0)).alias("landed"), F.coalesce("planned", F.expr("cast(array() AS array<bigint>)")).alias("planned"), (F.col("o_orderpriority") == "1-URGENT").alias("ranged"), (F.col("o_orderstatus") == "P").alias("waiting"), (F.col("o_orderstatus") == "F").alias("dies"))


@query(
    "f11_life_board",
    f"WITH v(vol, lo, hi, y0, y1) AS (SELECT i, i * 100, i * 100 + 99, DATE '1992-01-01' + (i * 200)::INT, DATE '1992-01-01' + (i * 200 + 199)::INT FROM range(0, 14) t(i)), {LIVES}, e AS (SELECT vol, count(*) FILTER (ends <= y1) AS last_chance, count(*) FILTER (ends > y1) AS near_end FROM p JOIN v ON ends >= y0 AND ends <= y1 + 20 GROUP BY vol), h AS (SELECT vol, count(DISTINCT l_orderkey) AS planned FROM lineitem JOIN v ON l_partkey BETWEEN lo AND hi WHERE l_returnflag = 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY vol) SELECT vol, coalesce(last_chance, 0) AS last_chance, coalesce(near_end, 0) AS near_end, coalesce(h.planned, 0) AS planned, (SELECT count(*) FROM p WHERE landed = 0 AND planned > 0) AS pending FROM v LEFT JOIN e USING (vol) LEFT JOIN h USING (vol)",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    vols = spark.range(14).select(F.col("id").alias("vol"), (F.col("id") * 100).alias("lo"), (F.col("id") * 100 + 99).alias("hi"), F.expr("date_add(DATE'1992-01-01', cast(id * 200 AS int))").alias("y0"), F.expr("date_add(DATE'1992-01-01', cast(id * 200 + 199 AS int))").alias("y1"))
    return ledgers.life_board(mortals(spark, d), vols, F.lit(20))


GAPS = f"{SEC}, v(vol, lo, hi) AS (VALUES (1, 1, 10), (2, 11, 30), (3, 31, 60)), k AS (SELECT corpus, seq FROM sec WHERE doc_id % 3 <> 0), c AS (SELECT DISTINCT corpus FROM k), w AS (SELECT corpus, vol, unnest(range(lo, hi + 1)) AS seq FROM c CROSS JOIN v), gaps AS (SELECT corpus, vol::BIGINT AS vol, seq FROM w ANTI JOIN k USING (corpus, seq))"


def written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return values(spark, "vol BIGINT, lo BIGINT, hi BIGINT", (1, 1, 10), (2, 11, 30), (3, 31, 60)), sections(spark, d).where("doc_id % 3 <> 0")


@query("f11_missing_sections", f"WITH {GAPS} SELECT g.corpus, g.vol, count(*) AS missing, min(seq) AS first, max(seq) AS last, CASE WHEN count(*) = any_value(hi - lo + 1) THEN 'unwritten' ELSE 'partial' END AS state FROM gaps g JOIN v ON v.vol = g.vol GROUP BY g.corpus, g.vol")
def f11b(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.missing_sections(*written(spark, d))


@query("f11_missing_numbers", f"WITH {GAPS} SELECT * FROM gaps")
def f11c(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.missing_numbers(*written(spark, d))


@query(
    "f12_life_board_lists",
    f"WITH {LIVES} SELECT name, 'no_landing' AS list FROM p WHERE landed = 0 AND (planned > 0 OR ranged) UNION ALL SELECT name, 'pending' FROM p WHERE waiting UNION ALL SELECT name, 'past_ceiling' FROM p WHERE landed = 0 AND dies AND ends <= DATE '1994-06-01'",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    people = mortals(spark, d).withColumn("planned", F.size("planned"))
    return ledgers.life_board_lists(people, F.lit("1994-06-01").cast("date"))


@query("f12_next_volume", f"WITH {GAPS}, m AS (SELECT corpus, vol, count(*) AS missing FROM gaps GROUP BY ALL) SELECT corpus, min(vol) AS vol, arg_min(missing, vol) AS missing FROM m GROUP BY corpus")
def f12b(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.next_volume(ledgers.missing_sections(*written(spark, d)))


@query(
    "f13_attribute_gate",
    "WITH cur AS (SELECT c_custkey AS name, c_mktsegment AS value FROM customer WHERE c_custkey % 50 <> 1), prior AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 40 = 0 THEN 'OTHER' ELSE c_mktsegment END AS prior FROM customer WHERE c_custkey % 60 <> 2), must AS (SELECT c_custkey AS name, 'BUILDING' AS must FROM customer WHERE c_custkey % 30 = 0), j AS (SELECT coalesce(cur.name, prior.name) AS name, value, prior FROM cur FULL JOIN prior ON cur.name = prior.name), k AS (SELECT j.name, CASE WHEN value IS NULL THEN 'removed' WHEN must IS NOT NULL AND value <> must THEN 'unexpected' WHEN prior IS NULL THEN 'added' WHEN value <> prior THEN 'changed' END AS status FROM j LEFT JOIN must USING (name)) SELECT * FROM k WHERE status IS NOT NULL",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("value"))
    prior = c.where("name % 60 <> 2").withColumn("value", F.expr("if(name % 40 = 0, 'OTHER', value)"))
    return ledgers.attribute_gate(c.where("name % 50 <> 1"), prior, c.where("name % 30 = 0").withColumn("value", F.lit("BUILDING")))


RULED = (("src0", "the"), ("src1", "und"), ("src2", "zzzzzz"), ("src3", "eau"))
RULED_SQL = "ru(corpus, anchor) AS (VALUES ('src0', 'the'), ('src1', 'und'), ('src2', 'zzzzzz'), ('src3', 'eau'))"


@query("f14_adjudications", f"WITH {SENTS}, {RULED_SQL}, c AS (SELECT corpus, sent, count(*) AS n FROM sen GROUP BY ALL HAVING count(*) >= 3) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM ru WHERE ru.corpus = c.corpus AND contains(c.sent, anchor))")
def f14(spark: SparkSession, d: str) -> DataFrame:
    repeated = metrics.repeated_sentences(sections(spark, d)).select("corpus", "sent", "n")
    return ledgers.apply_adjudications(repeated, values(spark, "corpus STRING, anchor STRING", *RULED))


@query("f14_resolved", f"WITH {SEC}, {RULED_SQL} SELECT corpus, anchor FROM ru WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.corpus = ru.corpus AND contains(text, anchor))")
def f14b(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.resolved_adjudications(values(spark, "corpus STRING, anchor STRING", *RULED), sections(spark, d))


@query(
    "f15_treated_gate",
    f"WITH {SENTS}, rep AS (SELECT corpus, sent FROM sen GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT corpus, seq, count(*) AS hits FROM sen JOIN rep USING (corpus, sent) GROUP BY ALL), t AS (SELECT corpus, seq, seq % 3 AS base FROM sec WHERE seq % 4 = 1) SELECT coalesce(h.corpus, t.corpus) AS corpus, coalesce(h.seq, t.seq) AS seq, coalesce(hits, 0) AS hits, base, CASE WHEN base IS NULL THEN 'report' WHEN coalesce(hits, 0) > base THEN 'fail' ELSE 'pass' END AS status FROM h FULL JOIN t ON h.corpus = t.corpus AND h.seq = t.seq",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    treated = s.where("seq % 4 = 1").select("corpus", "seq", (F.col("seq") % 3).alias("base"))
    return ledgers.treated_gate(metrics.repeat_hits(s).where("hits > 0").select("corpus", "seq", "hits"), treated)


@query(
    "k1_setup_closure",
    "WITH l AS (SELECT l_orderkey, min(l_shipdate) AS paid FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), s AS (SELECT o_orderkey AS id, CASE WHEN paid < o_orderdate THEN 'paid_early' WHEN o_orderdate + INTERVAL 60 DAY < TIMESTAMP '1995-06-17' AND o_orderstatus <> 'F' THEN 'overdue' WHEN paid IS NULL THEN 'no_payoff' END AS kind FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT * FROM s WHERE kind IS NOT NULL",
)
def k1(spark: SparkSession, d: str) -> DataFrame:
    paid = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("paid"))
    rows = table(spark, d, "orders").join(paid, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("planted"), "paid", F.expr("o_orderdate + interval 60 days").alias("due"), F.expr("if(o_orderstatus = 'F', 'paid', 'open')").alias("status"))
    return ledgers.setup_closure(rows, F.lit("1995-06-17 00:00:00").cast("timestamp")).select("id", "kind")


@query("k2_conflict_outlets", f"WITH {SEC} SELECT l.doc_id AS id, source AS corpus, (l.doc_id % 70)::BIGINT AS erupts FROM labels l JOIN documents USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.corpus = source AND sec.seq = l.doc_id % 70)")
def k2(spark: SparkSession, d: str) -> DataFrame:
    conflicts = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("corpus"), (F.col("doc_id") % 70).alias("erupts"))
    return ledgers.conflict_outlets(conflicts, sections(spark, d)).select("id", "corpus", "erupts")


@query("k3_bilocation", "SELECT user_id AS person, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS time, count(DISTINCT event_type) AS places FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def k3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("person"), F.date_format("ts", "yyyy-MM-dd HH").alias("time"), F.col("event_type").alias("place"))
    return ledgers.bilocation(e)


SECRETS = ["click", "purchase", "signup", "view"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("person"), F.col("event_type").alias("secret"), F.col("event_id").alias("seq"), F.expr("case event_id % 4 when 0 then 'knows' when 1 then 'half' when 2 then 'wrong' else 'not' end").alias("state"))


@query(
    "k4_knowledge_matrix",
    "WITH f AS (SELECT user_id AS person, event_type AS secret, arg_max(CASE event_id % 4 WHEN 0 THEN 'knows' WHEN 1 THEN 'half' WHEN 2 THEN 'wrong' ELSE 'not' END, event_id) AS state FROM events WHERE event_id <= 600 GROUP BY ALL) SELECT person, " + ", ".join(f"max(state) FILTER (secret = '{s}') AS {s}" for s in SECRETS) + " FROM f GROUP BY person",
)
def k4(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.knowledge_matrix(facts(spark, d), SECRETS, 600)


@query(
    "k4_knowledge_matrices",
    "WITH a AS (SELECT unnest([100, 250, 600, 999]) AS seq), f AS (SELECT a.seq, user_id AS person, event_type AS secret, arg_max(CASE event_id % 4 WHEN 0 THEN 'knows' WHEN 1 THEN 'half' WHEN 2 THEN 'wrong' ELSE 'not' END, event_id) AS state FROM events JOIN a ON event_id <= a.seq GROUP BY ALL) SELECT seq::BIGINT AS seq, person, " + ", ".join(f"max(state) FILTER (secret = '{s}') AS {s}" for s in SECRETS) + " FROM f GROUP BY seq, person",
)
def k4b(spark: SparkSession, d: str) -> DataFrame:
    """The matrices as of several events, from one as-of join."""
    return ledgers.knowledge_matrices(facts(spark, d), SECRETS, values(spark, "seq BIGINT", (100,), (250,), (600,), (999,)))


@query(
    "k5_knowledge_overreach",
    "WITH k AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.user_id AS person, 'product' AS secret, count(*) AS uses FROM events e LEFT JOIN k USING (user_id) WHERE event_type = 'purchase' AND (t IS NULL OR e.ts < t) GROUP BY e.user_id",
)
def k5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("person"), F.lit("product").alias("secret"), F.col("ts").alias("seq"), "event_type")
    return ledgers.knowledge_overreach(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"))
