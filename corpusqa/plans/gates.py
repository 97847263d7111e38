"""Queries I1-I8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.operators import gates, metrics, rules
from corpusqa.plans.metrics import MARKS, MET
from corpusqa.plans.registry import query
from corpusqa.plans.tables import CHANGED, PARAS, SEC, changed, sections, table, trimmed, values
from corpusqa.sources import numbered

FOUND = f"{SEC}, fi AS (SELECT corpus, CASE WHEN length(text) < 300 THEN 'under' WHEN length(text) > 6000 THEN 'over' ELSE 'marks' END AS rule, CASE WHEN length(text) BETWEEN 300 AND 6000 THEN 'info' ELSE 'fail' END AS severity, seq FROM sec WHERE length(text) < 300 OR length(text) > 6000 OR contains(text, '%%%'))"


def findings(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    rule = F.when(n < 300, "under").when(n > 6000, "over").otherwise("marks")
    return sections(spark, d).where((n < 300) | (n > 6000) | F.col("text").contains("%%%")).select("corpus", rule.alias("rule"), F.when(n.between(300, 6000), "info").otherwise("fail").alias("severity"), "seq")


@query("i1_classify", f"WITH {FOUND} SELECT corpus, rule, severity, seq, CASE WHEN severity = 'info' THEN 'info' WHEN seq < CASE rule WHEN 'under' THEN 20 ELSE 0 END THEN 'legacy' ELSE 'fail' END AS class FROM fi")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return gates.classify(findings(spark, d), values(spark, "rule STRING, enforced BIGINT", ("under", 20), ("marks", 5))).select("corpus", "rule", "severity", "seq", "class")


@query("i2_by_rule", f"WITH {FOUND} SELECT rule, count(*) AS n, count(DISTINCT (corpus, seq)) AS sections FROM fi GROUP BY rule")
def i2(spark: SparkSession, d: str) -> DataFrame:
    return gates.by_rule(findings(spark, d))


SIGNAL = "[A-Z][a-z]{4,8}"
SIG = "sa AS (SELECT conv_id, turn + 1 AS turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,8}')) AS signal FROM conversations), ca AS (SELECT conv_id, turn, signal, count(*) AS was FROM sa GROUP BY ALL), sb AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,8}')) AS signal FROM conversations), cb AS (SELECT conv_id, turn, signal, count(*) AS n FROM sb GROUP BY ALL), dd AS (SELECT conv_id, turn, signal, n - coalesce(was, 0) AS added FROM cb LEFT JOIN ca USING (conv_id, turn, signal))"


@query("i3_signal_delta", f"WITH {SIG} SELECT * FROM dd WHERE added > 0")
def i3(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return gates.signal_delta(turns.withColumn("turn", F.col("turn") + 1), turns, ["conv_id", "turn"], SIGNAL)


@query("i4_changed_sections", f"WITH {CHANGED}, j AS (SELECT c.corpus, c.doc_id, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN s.text <> c.text THEN 'modified' END AS status FROM chg c LEFT JOIN (SELECT * FROM sec WHERE doc_id % 89 <> 0) s ON s.corpus = c.corpus AND s.doc_id = c.doc_id) SELECT * FROM j WHERE status IS NOT NULL")
def i4(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    return gates.changed_sections(s.where("doc_id % 89 <> 0"), changed(s), ["corpus", "doc_id"])


MOVED = f"""{SEC}, bef AS (SELECT corpus, doc_id, text FROM sec),
    aft AS (SELECT corpus, CASE doc_id % 50 WHEN 7 THEN doc_id + 10000000 WHEN 8 THEN doc_id + 20000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 50 = 8 THEN text || chr(10) || 'x y' WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END AS text FROM sec WHERE doc_id % 101 <> 0
      UNION ALL SELECT corpus, doc_id + 30000000, text FROM sec WHERE doc_id % 50 = 9 UNION ALL SELECT corpus, doc_id + 40000000, 'zz' || doc_id FROM sec WHERE doc_id % 50 = 11),
    fresh AS (SELECT * FROM aft ANTI JOIN bef USING (corpus, doc_id)), gone AS (SELECT * FROM bef ANTI JOIN aft USING (corpus, doc_id)),
    fe AS (SELECT *, md5(text) AS s, row_number() OVER (PARTITION BY md5(text) ORDER BY corpus, doc_id) AS turn FROM fresh), ge AS (SELECT *, md5(text) AS s, row_number() OVER (PARTITION BY md5(text) ORDER BY corpus, doc_id) AS turn FROM gone),
    eq AS (SELECT fe.corpus, fe.doc_id, ge.corpus AS from_corpus, ge.doc_id AS from_doc_id FROM fe JOIN ge USING (s, turn)),
    fr AS (SELECT * FROM fresh ANTI JOIN eq USING (corpus, doc_id)), gr AS (SELECT corpus, doc_id, text FROM gone WHERE NOT EXISTS (SELECT 1 FROM eq WHERE from_corpus = gone.corpus AND from_doc_id = gone.doc_id)),
    bl AS (SELECT corpus, doc_id, {trimmed("l")} AS line FROM (SELECT corpus, doc_id, unnest(string_split(text, chr(10))) AS l FROM bef)), fl AS (SELECT corpus, doc_id, {trimmed("l")} AS line FROM (SELECT corpus, doc_id, unnest(string_split(text, chr(10))) AS l FROM fr)),
    bt AS (SELECT corpus, doc_id, line, count(*) AS k, sum(count(*)) OVER (PARTITION BY corpus, doc_id) AS n FROM bl WHERE line <> '' GROUP BY corpus, doc_id, line), ft AS (SELECT corpus, doc_id, line, count(*) AS k, sum(count(*)) OVER (PARTITION BY corpus, doc_id) AS n FROM fl WHERE line <> '' GROUP BY corpus, doc_id, line),
    li AS (SELECT f.corpus, f.doc_id, b.corpus AS from_corpus, b.doc_id AS from_doc_id, sum(least(f.k, b.k)) / greatest(any_value(f.n), any_value(b.n)) AS likeness FROM ft f JOIN bt b USING (line) GROUP BY f.corpus, f.doc_id, b.corpus, b.doc_id),
    pa AS (SELECT li.*, row_number() OVER (ORDER BY likeness DESC, from_corpus, from_doc_id, li.corpus, li.doc_id) AS r FROM li JOIN gr ON gr.corpus = from_corpus AND gr.doc_id = from_doc_id WHERE likeness >= 0.5),
    gd AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS a, []::BIGINT[] AS b, []::BIGINT[] AS took UNION ALL SELECT r, CASE WHEN ok THEN list_append(a, f) ELSE a END, CASE WHEN ok THEN list_append(b, g) ELSE b END, CASE WHEN ok THEN list_append(took, r) ELSE took END
      FROM (SELECT pa.r, gd.a, gd.b, gd.took, pa.doc_id AS f, pa.from_doc_id AS g, NOT list_contains(gd.a, pa.doc_id) AND NOT list_contains(gd.b, pa.from_doc_id) AS ok FROM gd JOIN pa ON pa.r = gd.r + 1)),
    rn AS (SELECT * EXCLUDE (r) FROM pa WHERE list_contains((SELECT took FROM gd ORDER BY r DESC LIMIT 1), r) UNION ALL SELECT corpus, doc_id, from_corpus, from_doc_id, 1::DOUBLE FROM eq),
    lf AS (SELECT * FROM fresh ANTI JOIN rn USING (corpus, doc_id)),
    sm AS (SELECT lf.corpus, lf.doc_id, bef.corpus AS from_corpus, bef.doc_id AS from_doc_id, 1::DOUBLE AS likeness, 0 AS o FROM lf JOIN bef USING (text) UNION ALL SELECT li.*, 1 FROM li JOIN lf USING (corpus, doc_id) WHERE likeness >= 0.5),
    cp AS (SELECT corpus, doc_id, from_corpus, from_doc_id, likeness FROM (SELECT *, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY o, likeness DESC, from_corpus, from_doc_id) AS i FROM sm) WHERE i = 1),
    mv AS (SELECT corpus, doc_id, 'renamed' AS status, from_corpus, from_doc_id, likeness FROM rn UNION ALL SELECT corpus, doc_id, 'copied', from_corpus, from_doc_id, likeness FROM cp)"""


@query(
    "i4_moved_sections",
    f"WITH RECURSIVE {MOVED} SELECT corpus, doc_id, status, from_corpus, from_doc_id, round(likeness::DOUBLE * 1000)::BIGINT AS likeness FROM mv UNION ALL SELECT corpus, doc_id, 'added', NULL, NULL, NULL FROM lf ANTI JOIN cp USING (corpus, doc_id) UNION ALL SELECT a.corpus, a.doc_id, 'modified', NULL, NULL, NULL FROM aft a JOIN bef b ON a.corpus = b.corpus AND a.doc_id = b.doc_id WHERE a.text <> b.text",
)
def i4b(spark: SparkSession, d: str) -> DataFrame:
    """Some documents have another key, some another key and a line more, some are there twice, some are new, some gone."""
    before = table(spark, d, "documents").select(F.col("source").alias("corpus"), "doc_id", "text")
    key = F.expr("CASE doc_id % 50 WHEN 7 THEN doc_id + 10000000 WHEN 8 THEN doc_id + 20000000 ELSE doc_id END")
    text = F.expr("CASE WHEN doc_id % 50 = 8 THEN concat(text, '\n', 'x y') WHEN doc_id % 97 = 0 THEN concat(text, '!') ELSE text END")
    after = before.where("doc_id % 101 <> 0").select("corpus", key.alias("doc_id"), text.alias("text"))
    after = after.unionByName(before.where("doc_id % 50 = 9").withColumn("doc_id", F.col("doc_id") + 30000000))
    after = after.unionByName(before.where("doc_id % 50 = 11").select("corpus", (F.col("doc_id") + 40000000).alias("doc_id"), F.concat(F.lit("zz"), F.col("doc_id").cast("string")).alias("text")))
    out = gates.moved_sections(before, after, ["corpus", "doc_id"])
    return out.withColumn("likeness", F.round(F.col("likeness") * 1000).cast("bigint"))


@query(
    "i5_compact_ranges",
    f"WITH {SEC}, k AS (SELECT DISTINCT corpus, seq FROM sec JOIN labels USING (doc_id)), g AS (SELECT corpus, seq, seq - row_number() OVER (PARTITION BY corpus ORDER BY seq) AS grp FROM k), r AS (SELECT corpus, min(seq) AS a, max(seq) AS b, row_number() OVER (PARTITION BY corpus ORDER BY min(seq)) AS run FROM g GROUP BY corpus, grp) SELECT corpus, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY run) FILTER (run <= 10) AS ranges, greatest(count(*) - 10, 0) AS more FROM r GROUP BY corpus",
)
def i5(spark: SparkSession, d: str) -> DataFrame:
    return gates.compact_ranges(sections(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id"), "corpus", "seq")


@query(
    "i6_revision_walk",
    "WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations) SELECT conv_id, turn, greatest(len(regexp_extract_all(text, '[A-Z][a-z]{4,8}')) - len(regexp_extract_all(before, '[A-Z][a-z]{4,8}')), 0) AS more FROM p",
)
def i6(spark: SparkSession, d: str) -> DataFrame:
    pairs = gates.revision_pairs(table(spark, d, "conversations"), "conv_id", "turn")
    n = lambda c: F.regexp_count(c, F.lit(SIGNAL))
    return pairs.select("conv_id", "turn", F.greatest(n(F.col("text")) - n(F.col("before")), F.lit(0)).cast("bigint").alias("more"))


@query("i7_gate_summary", f"WITH {FOUND}, s(step, kind, rule) AS (VALUES ('length', 'fail', 'under'), ('length', 'fail', 'over'), ('style', 'report', 'marks'), ('none', 'fail', 'absent')), c AS (SELECT rule, count(*) AS n FROM fi GROUP BY rule), g AS (SELECT step, kind, coalesce(sum(n), 0)::BIGINT AS n FROM s LEFT JOIN c USING (rule) GROUP BY ALL) SELECT *, kind = 'fail' AND n > 0 AS failed FROM g")
def i7(spark: SparkSession, d: str) -> DataFrame:
    steps = values(spark, "step STRING, kind STRING, rule STRING", ("length", "fail", "under"), ("length", "fail", "over"), ("style", "report", "marks"), ("none", "fail", "absent"))
    return gates.gate_summary(findings(spark, d), steps)


@query("i8_enforced", f"WITH {SEC}, v(vol, lo, hi) AS (VALUES (1, 1, 10), (2, 11, 30), (3, 31, 45)), p AS (SELECT corpus, vol, seq FROM sec JOIN v ON seq BETWEEN lo AND hi) SELECT corpus, vol::BIGINT AS vol, bool_or(seq BETWEEN 12 AND 14 OR seq BETWEEN 48 AND 99) AS strict FROM p GROUP BY ALL")
def i8(spark: SparkSession, d: str) -> DataFrame:
    vols = values(spark, "vol BIGINT, lo BIGINT, hi BIGINT", (1, 1, 10), (2, 11, 30), (3, 31, 45))
    return gates.enforced(vols, sections(spark, d), values(spark, "lo BIGINT, hi BIGINT", (12, 14), (48, 99)))


RULES = rules.section_rules(300, 6000, 50, 150)
RULE_FINDINGS = f"""{PARAS}, {MET}, rf AS (SELECT corpus, rule, severity, seq, NULL::VARCHAR AS subject, n::BIGINT AS n, detail FROM (
    SELECT corpus, seq, 'under_floor' AS rule, 'fail' AS severity, chars AS n, chars || ' < 300' AS detail FROM full_met WHERE chars < 300
    UNION ALL SELECT corpus, seq, 'over_ceiling', 'warn', chars, chars || ' > 6000' FROM full_met WHERE chars > 6000
    UNION ALL SELECT corpus, seq, 'no_paragraph', 'fail', 0, NULL FROM full_met WHERE n_all = 0
    UNION ALL SELECT corpus, seq, 'unpaired_quotes', 'fail', abs(opens - closes), opens || '/' || closes FROM full_met WHERE opens <> closes
    UNION ALL SELECT corpus, seq, 'half_width_quotes', 'warn', half, NULL FROM full_met WHERE half > 0
    UNION ALL SELECT corpus, seq, 'fragmented', 'info', short_all, short_all || '/' || n_all FROM full_met WHERE n_all > 0 AND short_all * 100 >= 50 * n_all
    UNION ALL SELECT corpus, seq, 'dense_pattern', 'info', hits, NULL FROM full_met WHERE hits * 10000 > 150 * chars))"""


def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules of sections on the documents, measured where they lie."""
    rows = table(spark, d, "documents").select(F.col("source").alias("corpus"), "doc_id", "text")
    return rules.evaluate(numbered(metrics.measure(rows, ["corpus", "doc_id"], marks=MARKS), "corpus", "doc_id"), RULES)


@query("i7_rule_findings", f"WITH {RULE_FINDINGS} SELECT * FROM rf")
def i7b(spark: SparkSession, d: str) -> DataFrame:
    return rule_findings(spark, d)


@query("i7_verdict_of_rules", f"WITH {RULE_FINDINGS} SELECT corpus, count(*) FILTER (severity = 'fail') AS fails, count(*) FILTER (severity = 'warn') AS warns, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'fail') > 0 AS failed FROM rf GROUP BY corpus")
def i7c(spark: SparkSession, d: str) -> DataFrame:
    return rules.verdict(rule_findings(spark, d))


STEP_ROWS = (("length", "fail", "under_floor"), ("length", "fail", "no_paragraph"), ("length", "report", "over_ceiling"), ("quotes", "fail", "unpaired_quotes"), ("quotes", "report", "half_width_quotes"), ("style", "report", "fragmented"), ("style", "report", "dense_pattern"), ("ledger", "fail", "absent"))
STEP_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in STEP_ROWS)


@query("i7_gate_of_rules", f"WITH {RULE_FINDINGS}, s(step, kind, rule) AS (VALUES {STEP_VALUES}), c AS (SELECT rule, count(*) AS n FROM rf GROUP BY rule), g AS (SELECT step, kind, coalesce(sum(n), 0)::BIGINT AS n FROM s LEFT JOIN c USING (rule) GROUP BY ALL) SELECT *, kind = 'fail' AND n > 0 AS failed FROM g")
def i7d(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_summary(rule_findings(spark, d), values(spark, "step STRING, kind STRING, rule STRING", *STEP_ROWS))
