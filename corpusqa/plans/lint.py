"""Queries H1-H10, over documents rewritten as marked-up text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.operators import lint
from corpusqa.plans.registry import query
from corpusqa.plans.tables import table

CORE = ("name", "role")
CARD = "^c[0-9]$"


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a marked-up one: its lines become headings, fields, rows or stay, by their length."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when(F.length(l) % 11 == 0, F.concat(F.repeat(F.lit("#"), F.length(l) % 4 + 1), F.lit(" c"), (F.length(l) % 2).cast("string"), F.when(F.length(l) % 33 == 0, " ## x").otherwise("")))
        .when(F.length(l) % 11 <= 3, F.concat(F.lit("- **"), F.when(F.length(l) % 2 == 0, "name").otherwise("role"), F.when(F.length(l) % 3 == 0, "s").otherwise(""), F.when(F.length(l) % 5 == 0, ":").otherwise("："), F.lit("** x")))
        .when(F.length(l) % 11 < 6, F.concat(F.lit("|"), F.repeat(F.lit("a|"), F.length(l) % 3 + 1)))
        .otherwise(l),
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(lines, "\n").alias("text"))


MARKED = """raw AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS l FROM documents),
    ml AS (SELECT doc, pos, CASE WHEN length(l) % 11 = 0 THEN repeat('#', (length(l) % 4 + 1)::INT) || ' c' || (length(l) % 2) || CASE WHEN length(l) % 33 = 0 THEN ' ## x' ELSE '' END
      WHEN length(l) % 11 <= 3 THEN '- **' || CASE WHEN length(l) % 2 = 0 THEN 'name' ELSE 'role' END || CASE WHEN length(l) % 3 = 0 THEN 's' ELSE '' END || CASE WHEN length(l) % 5 = 0 THEN ':' ELSE '：' END || '** x'
      WHEN length(l) % 11 < 6 THEN '|' || repeat('a|', (length(l) % 3 + 1)::INT) ELSE l END AS line FROM raw),
    lv AS (SELECT doc, pos, line, nullif(length(regexp_extract(line, '^(#{1,6}) +\\S', 1)), 0) AS level, nullif(trim(regexp_extract(line, '^- \\*\\*([^*：:]{1,20})[：:]', 1)), '') AS key FROM ml),
    dl AS (SELECT *, CASE WHEN level IS NOT NULL THEN trim(regexp_replace(line, '^#{1,6} +', '')) END AS heading, last_value(CASE WHEN level IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS "at" FROM lv)"""
FIND = {
    "glued_heading": "SELECT doc, 'glued_heading' AS \"check\", pos::BIGINT AS line, heading AS detail FROM dl WHERE level IS NOT NULL AND contains(heading, '##')",
    "level_jump": "SELECT doc, 'level_jump', pos::BIGINT, b || '>' || level FROM (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY pos) AS b FROM dl WHERE level IS NOT NULL) WHERE level > b + 1",
    "dup_card": "SELECT doc, 'dup_card', pos::BIGINT, name || '@' || first FROM (SELECT *, min(pos) OVER (PARTITION BY doc, level, name) AS first FROM (SELECT *, regexp_extract(trim(regexp_replace(heading, '^[0-9]+[a-z]?[.、]\\s*', '')), '^([^（(｜|·\\s—/]*)', 1) AS name FROM dl WHERE level >= 3 AND EXISTS (SELECT 1 FROM dl x WHERE x.doc = dl.doc AND x.\"at\" = dl.pos AND x.key IS NOT NULL)) WHERE regexp_matches(name, '^c[0-9]$')) WHERE pos > first",
    "dup_field": "SELECT doc, 'dup_field', pos::BIGINT, key || '@' || first FROM (SELECT *, min(pos) OVER (PARTITION BY doc, coalesce(\"at\", -1), key) AS first FROM dl WHERE key IS NOT NULL) WHERE pos > first",
    "colon": "SELECT doc, 'colon', pos::BIGINT, key FROM dl WHERE regexp_matches(line, '^- \\*\\*[^*：:]{1,20}:')",
    "field_alias": "SELECT doc, 'field_alias', min(pos)::BIGINT, string_agg(DISTINCT key, '/' ORDER BY key) FROM (SELECT *, CASE WHEN contains(key, 'name') THEN 'name' WHEN contains(key, 'role') THEN 'role' END AS core FROM dl WHERE length(key) <= 8) WHERE core IS NOT NULL GROUP BY doc, core HAVING count(DISTINCT key) > 1",
    "table_columns": "SELECT doc, 'table_columns', pos::BIGINT, cells || '/' || header FROM (SELECT *, first_value(cells) OVER (PARTITION BY doc, run ORDER BY pos) AS header FROM (SELECT doc, pos, len(string_split(trim(line), '|')) AS cells, run FROM (SELECT *, sum(CASE WHEN starts_with(trim(line), '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM dl) WHERE starts_with(trim(line), '|'))) WHERE cells <> header",
}


def found(spark: SparkSession, d: str, check: str) -> DataFrame:
    docs = marked(spark, d)
    lines = lint.doc_lines(docs)
    if check == "field_alias":
        return lint.lint_field_alias(lines, CORE)
    if check == "table_columns":
        return lint.lint_table_columns(docs)
    return {"glued_heading": lint.lint_glued, "level_jump": lint.lint_level_jump, "dup_card": lambda lines: lint.lint_dup_card(lines, person=CARD), "dup_field": lint.lint_dup_field, "colon": lint.lint_colon}[check](lines)


@query("h1_doc_lines", f"WITH {MARKED} SELECT doc, count(*) AS lines, count(level) AS headings, count(key) AS fields, count(\"at\") AS below, sum(coalesce(\"at\", 0))::BIGINT AS at_sum FROM dl GROUP BY doc")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return lint.doc_lines(marked(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.count("level").alias("headings"), F.count("key").alias("fields"), F.count("at").alias("below"), F.sum(F.coalesce("at", F.lit(0))).alias("at_sum"))


def _register() -> None:
    for i, check in enumerate(FIND, 2):
        sql = f"WITH {MARKED} SELECT * FROM ({FIND[check]}) t(doc, \"check\", line, detail)"
        query(f"h{i}_{check}", sql)(lambda spark, d, check=check: found(spark, d, check))


_register()
QUOTES = """c0 AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS c FROM documents), c1 AS (SELECT *, sum(CASE WHEN c = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS pos FROM c0), ch AS (SELECT * FROM c1 WHERE c IN ('S', 'T')),
    dp AS (SELECT *, sum(CASE c WHEN 'S' THEN 1 ELSE -1 END) OVER (PARTITION BY doc ORDER BY i) AS s FROM ch), fl AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc ORDER BY i)) AS f FROM dp),
    tt AS (SELECT doc, sum(CASE c WHEN 'S' THEN 1 ELSE -1 END) AS total, min(i) FILTER (s < 0) AS bad, max(i) FILTER (s = f) AS lz FROM fl GROUP BY doc),
    q AS (SELECT tt.doc, total, coalesce((SELECT min(pos) FROM fl WHERE fl.doc = tt.doc AND i = bad), (SELECT min(pos) FROM fl WHERE fl.doc = tt.doc AND c = 'S' AND i > coalesce(lz, 0))) AS line FROM tt WHERE total <> 0)"""


@query("h9_quote_imbalance", f"WITH {QUOTES} SELECT doc, 'quote_imbalance' AS \"check\", line::BIGINT AS line, total::VARCHAR AS detail FROM q")
def h9(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint_quotes(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "S", "T")


ALL = " UNION ALL ".join(FIND.values())
TIER_SQL = "CASE \"check\" " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in lint.TIERS.items()) + " END"


@query("h10_lint_summary", f"WITH {MARKED}, f AS (SELECT * FROM ({ALL}) t(doc, \"check\", line, detail)) SELECT doc, {TIER_SQL} AS tier, count(*) AS n, CASE WHEN {TIER_SQL} = 1 THEN 'fail' ELSE 'report' END AS verdict FROM f GROUP BY ALL")
def h10(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint_summary(lint.lint_all(marked(spark, d), CORE, CARD))


@query("h10_lint_findings", f"WITH {MARKED} SELECT * FROM ({ALL}) t(doc, \"check\", line, detail)")
def h10b(spark: SparkSession, d: str) -> DataFrame:
    """All checks of lines in one pass."""
    return lint.lint_all(marked(spark, d), CORE, CARD)
