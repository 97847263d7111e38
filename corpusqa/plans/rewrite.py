"""Queries J1-J3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.operators import rewrite
from corpusqa.plans.registry import query
from corpusqa.plans.tables import CJK_SEC, PARAS, SEC, bare, cjk, paras, sections, table
from corpusqa.schemas import CJK, LATIN, LangPack

RULES = [("the", "THE"), ("THE ", "DIE "), ("que", "qu"), (". ", ".  ")]


@query(
    "j1_apply_rules",
    f"""WITH {SEC}, a AS (SELECT corpus, seq, text, replace(text, 'the', 'THE') AS t1 FROM sec WHERE doc_id % 10 <> 0), b AS (SELECT *, replace(t1, 'THE ', 'DIE ') AS t2 FROM a), c AS (SELECT *, replace(t2, 'que', 'qu') AS t3 FROM b)
    SELECT corpus, seq, md5(replace(t3, '. ', '.  ')) AS text, (length(text) - length(replace(text, 'the', ''))) // 3 + (length(t1) - length(replace(t1, 'THE ', ''))) // 4 + (length(t2) - length(replace(t2, 'que', ''))) // 3 + (length(t3) - length(replace(t3, '. ', ''))) // 2 AS replaced FROM c""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    return rewrite.apply_rules(s, RULES, s.where("doc_id % 10 = 0").select("corpus", "seq")).withColumn("text", F.md5("text"))


@query(
    "j2_coalesce_invariant",
    f"WITH {PARAS}, ls AS (SELECT corpus, seq, string_agg(para, '' ORDER BY pos) AS joined FROM par GROUP BY corpus, seq) SELECT corpus, seq, md5(coalesce(joined, '')) AS joined FROM sec LEFT JOIN ls USING (corpus, seq)",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Documents have no headings, so that their paragraphs are all of them."""
    out = rewrite.coalesce_paragraphs(sections(spark, d), 110, LATIN)
    return out.select("corpus", "seq", F.md5(F.replace("text", F.lit("\n"), F.lit(""))).alias("joined"))


def coalesced(sec: str, pack: LangPack, target: int = 110) -> str:
    """The fold as a recursive query over the sections ``sec``, one paragraph a step."""
    o, c = pack.openers[0], pack.closers[0]
    return f"""{paras(sec)}, fe AS (SELECT corpus, seq, row_number() OVER w AS i, count(*) OVER (PARTITION BY corpus, seq) AS k, para, n, starts_with(para, '{o}') AS q, contains(para, '{o}') AS o, contains(para, '{c}') AS c, ends_with(para, '：') AS colon,
        regexp_matches(para, '{pack.attribution}') AS attr, contains(para, '{c}') AND length({bare(f"string_split(para, '{c}')[-1]")}) > 0 AS own, n <= 16 AND regexp_matches(para, '^(?:{pack.scene})') AS shift FROM par WINDOW w AS (PARTITION BY corpus, seq ORDER BY pos)),
    fl AS (SELECT *, coalesce(max(i) FILTER (c) OVER (PARTITION BY corpus, seq), 0) AS lastc FROM fe),
    fold AS (SELECT corpus, seq, i, k, para AS txt, q, n, colon, own, c AS hc, q AND NOT c AS opened, q AND NOT c AND i <= lastc AS block FROM fl WHERE i = 1
      UNION ALL SELECT corpus, seq, i, k, CASE WHEN m THEN txt || para ELSE txt || chr(10) || para END, CASE WHEN m THEN bq ELSE q END, CASE WHEN m THEN bn + n ELSE n END, colon, CASE WHEN c THEN own ELSE m AND bhc END, c OR (m AND bhc), NOT c AND (bopened OR q), inside
      FROM (SELECT *, i < k AND NOT shift AND NOT inside AND NOT bblock AND ((NOT bq AND NOT q AND bn < {target} AND (attr OR NOT o)) OR (NOT bq AND q AND bcolon) OR (bq AND NOT q AND bn < {target} AND bown AND NOT attr)) AS m
        FROM (SELECT fl.*, b.txt, b.q AS bq, b.n AS bn, b.colon AS bcolon, b.own AS bown, b.hc AS bhc, b.opened AS bopened, b.block AS bblock, (b.opened OR (fl.q AND NOT fl.c)) AND fl.i <= fl.lastc AS inside FROM fold b JOIN fl ON fl.corpus = b.corpus AND fl.seq = b.seq AND fl.i = b.i + 1))),
    heads AS (SELECT corpus, seq, string_agg(para, chr(10) ORDER BY pos) AS head FROM trimmed WHERE starts_with(para, '#') GROUP BY corpus, seq),
    co AS (SELECT corpus, seq, concat_ws(chr(10), head, (SELECT txt FROM fold WHERE fold.corpus = s.corpus AND fold.seq = s.seq AND fold.i = fold.k)) AS text FROM {sec} s LEFT JOIN heads USING (corpus, seq))"""


@query("j2_coalesce_paragraphs", f"WITH RECURSIVE {SEC}, {coalesced('sec', LATIN)} SELECT corpus, seq, text FROM co")
def j2b(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.coalesce_paragraphs(sections(spark, d), 110, LATIN)


@query("j2_coalesce_cjk", f"WITH RECURSIVE {CJK_SEC}, {coalesced('csec', CJK)} SELECT corpus, seq, md5(text) AS text FROM co")
def j2c(spark: SparkSession, d: str) -> DataFrame:
    """Documents rewritten with headings, full-width indents, quotes and marks of CJK prose."""
    return rewrite.coalesce_paragraphs(cjk(sections(spark, d)), 110, CJK).withColumn("text", F.md5("text"))


@query(
    "j3_upsert_segment",
    "WITH d AS (SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN '# T' || chr(10) || text WHEN doc_id % 3 = 1 THEN text || chr(10) || '<!-- b -->' || chr(10) || 'old' || chr(10) || '<!-- e -->' || 'tail' ELSE text END AS text FROM documents), s AS (SELECT doc_id, 'q' || quality AS seg FROM labels), j AS (SELECT doc, text, seg, '<!-- b -->' || chr(10) || seg || chr(10) || '<!-- e -->' AS block FROM d LEFT JOIN s ON s.doc_id = d.doc) SELECT doc, md5(CASE WHEN seg IS NULL THEN text WHEN doc % 3 = 0 THEN '# T' || chr(10) || block || substr(text, 4) WHEN doc % 3 = 1 THEN replace(text, '<!-- b -->' || chr(10) || 'old' || chr(10) || '<!-- e -->', block) ELSE block || chr(10) || text END) AS text FROM j",
)
def j3(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id") % 3
    text = F.when(c == 0, F.concat(F.lit("# T\n"), "text")).when(c == 1, F.concat("text", F.lit("\n<!-- b -->\nold\n<!-- e -->tail"))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"))
    segments = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("segment"))
    return rewrite.upsert_segment(docs, segments, "<!-- b -->", "<!-- e -->").withColumn("text", F.md5("text"))
