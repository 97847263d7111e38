"""Queries G1-G7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.operators import reconcile
from corpusqa.plans.registry import query
from corpusqa.plans.tables import CHANGED, SEC, changed, sections, table, values


@query(
    "g1_mirror_diff",
    f"WITH {CHANGED}, a AS (SELECT corpus, doc_id, text FROM sec WHERE doc_id % 103 <> 0), j AS (SELECT coalesce(a.corpus, chg.corpus) AS corpus, coalesce(a.doc_id, chg.doc_id) AS doc_id, CASE WHEN chg.text IS NULL THEN 'missing' WHEN a.text IS NULL THEN 'extra' WHEN md5(a.text) <> md5(chg.text) THEN 'differs' END AS status FROM a FULL JOIN chg ON a.corpus = chg.corpus AND a.doc_id = chg.doc_id) SELECT * FROM j WHERE status IS NOT NULL",
)
def g1(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    return reconcile.mirror_diff(s.where("doc_id % 103 <> 0"), changed(s), ["corpus", "doc_id"], "text")


@query("g2_index_coverage", "SELECT source AS corpus, count(*) AS items, (count(l.doc_id) + coalesce(any_value(x.extra), 0))::BIGINT AS listed, count(*) FILTER (l.doc_id IS NULL) AS unlisted, coalesce(any_value(x.extra), 0)::BIGINT AS extra FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT 'src' || (doc_id % 20) AS corpus, count(*) AS extra FROM labels WHERE doc_id % 7 = 0 GROUP BY ALL) x ON x.corpus = d.source GROUP BY source")
def g2(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.col("source").alias("corpus"), "doc_id")
    labels = table(spark, d, "labels")
    # Entries of items that exist, and some that point to none.
    foreign = labels.where("doc_id % 7 = 0").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("corpus"), (-1 - F.col("doc_id")).alias("doc_id"))
    index = labels.join(items, "doc_id").select("corpus", "doc_id").unionByName(foreign)
    return reconcile.index_coverage(items, index, "doc_id", "corpus")


TITLES = "t AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE WHEN page_id % 11 = 0 THEN '?' ELSE '' END AS d, CASE WHEN page_id % 13 = 0 THEN '' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS h FROM pages)"


@query(
    "g3_title_reconcile",
    f"WITH {TITLES}, a AS (SELECT id // 50 AS vol, id, d FROM t WHERE id % 17 <> 0), b AS (SELECT id, h FROM t WHERE id % 19 <> 0), j AS (SELECT a.id, vol, CASE WHEN b.id IS NULL THEN 'section_missing' WHEN h = '' THEN 'heading_absent' WHEN d <> h THEN 'mismatch' END AS status FROM a LEFT JOIN b ON a.id = b.id), r AS (SELECT vol, min(id) AS lo, max(id) AS hi FROM a GROUP BY vol) SELECT *, CASE WHEN status = 'section_missing' AND id > (SELECT count(*) FROM b) THEN 'warn' ELSE 'fail' END AS severity FROM j WHERE status IS NOT NULL UNION ALL SELECT id, vol, 'beyond_source', 'warn' FROM j WHERE status = 'section_missing' UNION ALL SELECT id, vol, 'undeclared', 'warn' FROM b JOIN r ON id BETWEEN lo AND hi WHERE id NOT IN (SELECT id FROM a)",
)
def g3(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    declared = p.where("page_id % 17 <> 0").select(F.expr("page_id div 50").alias("vol"), F.col("page_id").alias("id"), F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(F.col("page_id") % 11 == 0, "?").otherwise("")).alias("title"))
    actual = p.where("page_id % 19 <> 0").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 13 == 0, "").otherwise(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"))
    return reconcile.title_reconcile(declared, actual)


@query(
    "g4_progress_check",
    "WITH p AS (SELECT source AS corpus, count(*) - CASE WHEN source LIKE '%3' THEN 1 ELSE 0 END AS current, count(*) - CASE WHEN source LIKE '%7' THEN 2 ELSE 0 END AS total, count(*) AS last, count(*) - CASE WHEN source LIKE '%5' THEN 1 ELSE 0 END AS mirrored FROM documents GROUP BY source) SELECT corpus, 'current_not_last' AS rule FROM p WHERE current <> last UNION ALL SELECT corpus, 'current_over_total' FROM p WHERE current > total UNION ALL SELECT corpus, 'mirror_differs' FROM p WHERE mirrored <> current",
)
def g4(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    n = s.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    off = lambda end, k: F.col("n") - F.when(F.col("corpus").endswith(end), k).otherwise(0)
    return reconcile.progress_check(n.select("corpus", off("3", 1).alias("current"), off("7", 2).alias("total")), s, n.select("corpus", off("5", 1).alias("current")))


@query("g5_sequence_gaps", f"WITH {SEC}, k AS (SELECT corpus, seq FROM sec JOIN labels USING (doc_id)), m AS (SELECT corpus, max(seq) AS e FROM k GROUP BY corpus), w AS (SELECT corpus, unnest(range(1, e + 1)) AS seq FROM m) SELECT * FROM w ANTI JOIN k USING (corpus, seq)")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.sequence_gaps(sections(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id"))


@query("g6_bucket_of", f"WITH {SEC} SELECT corpus, seq, CASE WHEN seq >= 40 THEN 'late' WHEN seq >= 16 THEN 'middle' WHEN seq >= 4 THEN 'early' END AS name FROM sec")
def g6(spark: SparkSession, d: str) -> DataFrame:
    starts = values(spark, "kind STRING, name STRING, start BIGINT", ("s", "early", 4), ("s", "middle", 16), ("s", "late", 40))
    return reconcile.bucket_of(sections(spark, d).select("corpus", "seq"), starts)


@query(
    "g7_stage_status",
    "WITH p AS (SELECT source AS corpus, count(*) % 5 + 1 AS current, sum(length(text)) % 2 AS odd FROM documents GROUP BY source), s(stage) AS (VALUES (1), (2), (3), (4), (5)) SELECT corpus, stage::BIGINT AS stage, CASE WHEN stage < current THEN 'done' WHEN stage = current THEN 'active' ELSE 'todo' END AS status, stage = 2 OR (stage = 3 AND odd = 1) AS has_artifact FROM p CROSS JOIN s",
)
def g7(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy(F.col("source").alias("corpus")).agg((F.count(F.lit(1)) % 5 + 1).alias("stage"), (F.sum(F.length("text")) % 2).alias("odd"))
    artifacts = c.select("corpus", F.explode(F.array(F.struct(F.lit(2).cast("bigint").alias("stage"), F.lit(1).cast("bigint").alias("size")), F.struct(F.lit(3).cast("bigint").alias("stage"), F.col("odd").alias("size")))).alias("x")).select("corpus", "x.*")
    return reconcile.stage_status(c, values(spark, "stage BIGINT", *((i,) for i in range(1, 6))), artifacts)
