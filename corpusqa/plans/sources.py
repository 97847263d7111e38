"""Queries A1-A11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa import sources as src
from corpusqa.plans.lint import MARKED, marked
from corpusqa.plans.registry import query
from corpusqa.plans.tables import SEC, sections, table


@query("a1_sections", f"WITH {SEC} SELECT corpus, seq, doc_id, md5(text) AS text FROM sec")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("corpus", "seq", "doc_id", F.md5("text").alias("text"))


@query("a2_ledger_fields", "SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k)::BIGINT AS total FROM (SELECT event_type, TRY_CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type")
def a2(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("total"))


@query("a2_ledger_findings", "SELECT n_nationkey AS corpus, CASE WHEN n_nationkey % 5 IN (0, 3) THEN 0 ELSE 1 END AS rows, CASE WHEN n_nationkey % 5 = 3 THEN 'not_applicable' WHEN n_nationkey % 5 = 0 THEN 'invalid' ELSE 'read' END AS finding FROM nation")
def a2b(spark: SparkSession, d: str) -> DataFrame:
    """A ledger file for each nation but some; others don't parse."""
    path = src.scratch(spark)
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("corpus"), "n_name")
    text = F.when(F.col("corpus") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("n_name").alias("name"))))
    nations.where("corpus % 5 <> 3").select("corpus", text.alias("value")).write.partitionBy("corpus").text(path)
    ledger = src.read_ledger(spark, path, "name STRING").withColumn("corpus", F.col("corpus").cast("bigint"))
    return src.ledger_findings(ledger, nations)


OUTLINE = "'第' || (page_id % 40 + 1) || '章《' || trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) || '》'"


@query(
    "a3_declared_titles",
    "WITH t AS (SELECT page_id, page_id % 7 AS corpus, page_id % 40 + 1 AS seq, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages) SELECT corpus::VARCHAR AS corpus, seq, arg_min(title, page_id) AS title FROM t WHERE title <> '' GROUP BY corpus, seq",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("line", F.concat(F.lit("第"), (F.col("page_id") % 40 + 1).cast("string"), F.lit("章《"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("》")))
    # Each page declares its section in an outline text of its own; the first page of a number holds.
    return src.declared_titles(pages.select((F.col("page_id") % 7).cast("string").alias("corpus"), "page_id", F.col("line").alias("text")), order="page_id")


TENS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")


@query(
    "a4_volume_ranges",
    f"WITH {SEC}, d AS (SELECT corpus, (seq + 9) // 10 AS vol, min(seq) AS lo, max(seq) AS hi FROM sec GROUP BY ALL) SELECT corpus, vol, lo, hi FROM d WHERE corpus NOT LIKE '%3' UNION ALL SELECT corpus, vol, lo, hi FROM d WHERE corpus LIKE '%3' AND vol <= 10",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of declared sections; corpora that declare none take those of an outline text."""
    numbers = sections(spark, d).select("corpus", "seq", F.expr("(seq + 9) div 10").alias("vol"))
    numeral = F.element_at(F.array(*(F.lit(x) for x in TENS)), F.col("vol").cast("int"))
    line = F.concat(F.lit("第"), numeral, F.lit("卷："), F.expr("cast(hi - lo + 1 AS string)"), F.lit("章（第"), F.col("lo").cast("string"), F.lit("—"), F.col("hi").cast("string"), F.lit("章）\n"))
    outline = src.volumes_from_declared(numbers).where("vol <= 10").select("corpus", line.alias("text"))
    return src.first_volumes(src.volumes_from_declared(numbers.where("corpus NOT LIKE '%3'")), src.volumes_from_text(outline))


@query(
    "a5_roster",
    r"""WITH n AS (SELECT trim(unnest(string_split(text, ' '))) AS name, lang AS g FROM documents UNION ALL SELECT trim(unnest(string_split(text, ' '))), role FROM conversations)
    SELECT name, string_agg(DISTINCT g, '/' ORDER BY g) AS groups FROM n WHERE length(name) BETWEEN 3 AND 6 AND NOT regexp_matches(name, '[^A-Za-z]') GROUP BY name""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t, g: table(spark, d, t).select(F.explode(F.split("text", " ")).alias("name"), F.col(g).alias("group"))
    out = src.build_roster(words("documents", "lang"), words("conversations", "role"), min_len=3, max_len=6, exclude="[^A-Za-z]")
    return out.select("name", F.array_join("groups", "/").alias("groups"))


@query(
    "a6_table_cells",
    f"""WITH {MARKED}, m AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS run FROM ml)
    SELECT doc, pos::BIGINT AS pos, run, len(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'))::BIGINT AS cells FROM m WHERE starts_with(trim(line), '|')""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return src.table_cells(marked(spark, d), "doc").select("doc", "pos", "run", F.size("cells").cast("bigint").alias("cells"))


@query("a6_seat_holders", "WITH c AS (SELECT doc_id, trim(unnest(string_split(text, '|'))) AS name, generate_subscripts(string_split(text, '|'), 1) AS i FROM documents WHERE contains(text, '|')) SELECT doc_id, i::VARCHAR AS seat, name FROM c WHERE name <> '' AND NOT regexp_matches(name, '^(?:空|虚位|—|-|-+|:?-+:?)$')")
def a6b(spark: SparkSession, d: str) -> DataFrame:
    # Cells of documents with bars as rows of a ranked table.
    cells = table(spark, d, "documents").where(F.col("text").contains("|")).select("doc_id", F.posexplode(F.transform(F.split("text", r"\|"), lambda x: F.regexp_replace(x, "^ +| +$", ""))).alias("i", "name"))
    rows = cells.select("doc_id", F.array((F.col("i") + 1).cast("string"), "name").alias("cells"))
    return src.seat_holders(rows, "doc_id")


@query("a7_publish_roundtrip", f"WITH {SEC} SELECT corpus, count(*) AS sections, sum(length(text))::BIGINT AS chars FROM sec GROUP BY corpus")
def a7(spark: SparkSession, d: str) -> DataFrame:
    path = src.scratch(spark)
    rows = sections(spark, d)
    src.publish(rows.where("seq % 2 = 0"), path)
    src.publish(rows, path)  # takes the place of what was there
    return spark.read.parquet(path).groupBy(F.col("corpus").cast("string").alias("corpus")).agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("text")).alias("chars"))


@query(
    "a8_catalog",
    "WITH s AS (SELECT source AS corpus, count(*) AS sections FROM documents GROUP BY source), p AS (SELECT source AS corpus, count(*) FILTER (l.doc_id IS NOT NULL) AS current, count(*) AS total FROM documents LEFT JOIN labels l USING (doc_id) WHERE source <> 'src3' GROUP BY source) SELECT corpus, sections, coalesce(current, 0) AS current, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) = 0 THEN 0 ELSE least(100, (current * 200 + total) // (total * 2)) END AS percent FROM s LEFT JOIN p USING (corpus)",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    labelled = table(spark, d, "labels").select("doc_id").withColumn("l", F.lit(1))
    progress = s.where("corpus <> 'src3'").join(labelled, "doc_id", "left").groupBy("corpus").agg(F.count("l").alias("current"), F.count(F.lit(1)).alias("total"))
    return src.catalog(s, progress)


@query(
    "a9_progress_fields",
    "SELECT conv_id, max(turn) AS current, count(*) AS total, any_value(CASE WHEN conv_id % 2 = 0 THEN 'open' ELSE 'closed' END) AS status FROM conversations GROUP BY conv_id",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("c"), F.count(F.lit(1)).alias("t"))
    text = F.format_string("stage: 4\ncurrent: %d\ntotal: %d\nstatus: %s \n", "c", "t", F.when(F.col("conv_id") % 2 == 0, "open").otherwise("closed"))
    return src.parse_progress(state.select("conv_id", text.alias("text"))).select("conv_id", "current", "total", "status")


@query(
    "a10_upsert",
    "WITH b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), i AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey) SELECT * FROM i UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM i)",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    incoming = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return src.upsert(base, incoming, "k", "o_orderkey")


@query(
    "a10_upsert_by_title",
    "WITH b AS (SELECT regexp_replace(trim(p_name), '\\s+', '-', 'g') AS id, min(p_partkey) AS v FROM part GROUP BY 1), i AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'own-' || p_partkey ELSE regexp_replace(trim(p_name), '\\s+', '-', 'g') END AS id, p_partkey AS v FROM part WHERE p_size % 5 = 0), l AS (SELECT id, max(v) AS v FROM i GROUP BY id) SELECT * FROM l UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM l)",
)
def a10b(spark: SparkSession, d: str) -> DataFrame:
    """Imported rows without an id take their title's."""
    part = table(spark, d, "part")
    titled = lambda df, given: df.select(src.default_id(F.col("p_name"), given).alias("id"), F.col("p_partkey").alias("v"))
    base = titled(part, F.lit("")).groupBy("id").agg(F.min("v").alias("v"))
    given = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("own-"), F.col("p_partkey").cast("string")))
    return src.upsert(base, titled(part.where("p_size % 5 = 0"), given), "id", "v")


@query("a11_report_roundtrip", f"WITH {SEC} SELECT corpus, 'under' AS rule, count(*) AS n FROM sec WHERE length(text) < 300 GROUP BY corpus")
def a11(spark: SparkSession, d: str) -> DataFrame:
    path = src.scratch(spark)
    src.write_report(sections(spark, d).where(F.length("text") < 300).select("corpus", F.lit("under").alias("rule"), "seq"), path)
    return spark.read.schema("corpus STRING, rule STRING, seq BIGINT").json(path).groupBy("corpus", "rule").agg(F.count(F.lit(1)).alias("n"))
